"""The registered queries of the operators, each over its whole table, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import alignment, ann, binary_records, decontam, html_text, interpolation, langid, mixing, secrets, simhash, substring, vector_codes, warc
from .common import shared_dir


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token records of all documents, written, read back and indexed. Null texts have the end id alone; null ids come first; repeats stay. An empty table gives no rows."""
    path = shared_dir(spark)
    binary_records.write_records(table(spark, sf_dir, "documents"), path, tokenizer_file(), end_id=1, words_apart=True)
    index = binary_records.write_index(spark, path, f"{path}-index")
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of all pages, written and read back. Null html is an empty payload; equal payloads of 100 bytes and more are revisits of the smallest id. An empty table gives no rows."""
    path = shared_dir(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and wordless texts have the fingerprint 0 and link; ties and repeats share a component. An empty table gives no rows."""
    return simhash.report(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page without the subtrees that recur on its host. Null and empty html give an empty text; repeats give equal rows. An empty table gives no rows."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by its text alone. Null texts and texts without letters are `und`; ties go to the first language by name. An empty table gives no rows."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated windows cover. Null texts have no words; repeated documents lose all that windows cover. An empty table gives no rows."""
    return substring.report(table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector. Null, zero and non-finite vectors take no part; ties go to the smaller id; repeats count once. An empty table gives no rows."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. Null texts have size 0; a null source is the last source; equal rows share a decision. An empty table gives no rows."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by rules and network. Null texts have none; repeated documents have equal spans. An empty table gives no rows."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document. Null texts have no words, null items no windows; a null item_id stands in no list but counts. An empty table gives no rows."""
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under a model learned from nine tenths of them. Null texts have the end token only; repeated rows count each. An empty table gives no rows."""
    return interpolation.score(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over every document. Null, empty and not reproducible texts have zeros; ties are all best; repeated rows count each. An empty table gives no rows."""
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code of every vector, with codebooks fitted on all of them. Null, empty and non-finite vectors are dropped; ties go to the lower entry; repeats count each. An empty table gives no rows."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_records": op1_records,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_html": op4_html,
    "op5_langid": op5_langid,
    "op6_substring": op6_substring,
    "op7_ann": op7_ann,
    "op8_mix": op8_mix,
    "op9_secrets": op9_secrets,
    "op10_decontam": op10_decontam,
    "op11_lm_score": op11_lm_score,
    "op12_alignment": op12_alignment,
    "op13_vector_codes": op13_vector_codes,
}


def _codes_sql(components: int = 16) -> str:
    """Four rounds over vectors of four parts with so many components each, a step of the chain for each."""
    place = range(1, components + 1)
    distance = " + ".join(f"(a.x[{i}] - b.x[{i}]) * (a.x[{i}] - b.x[{i}])" for i in place)
    floored = ", ".join(f"(sum(x[{i}]) - (sum(x[{i}]) % count(*) + count(*)) % count(*)) // count(*)" for i in place)
    steps = [f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c : CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c : c IS NULL OR NOT isfinite(c))) = 0),
y AS (SELECT r, vec_id, label, p, list_slice(x, p * {components} + 1, p * {components} + {components}) AS x FROM v, range(4) t(p)),
b0 AS (SELECT p, r - 1 AS e, x FROM y WHERE r <= 256)"""]
    for n in range(5):
        steps.append(f"d{n} AS (SELECT a.r, a.p, a.vec_id, a.label, a.x, b.e, {distance} AS d FROM y a JOIN b{n} b ON a.p = b.p)")
        steps.append(f"a{n} AS (SELECT r, p, any_value(vec_id) AS vec_id, any_value(label) AS label, any_value(x) AS x, min(d) AS d, arg_min(e, d * 256 + e) AS e FROM d{n} GROUP BY r, p)")
        if n < 4:
            steps.append(f"m{n} AS (SELECT p, e, [{floored}] AS x FROM a{n} GROUP BY p, e)")
            steps.append(f"b{n + 1} AS (SELECT b.p, b.e, CASE WHEN m.x IS NULL THEN b.x ELSE m.x END AS x FROM b{n} b LEFT JOIN m{n} m ON b.p = m.p AND b.e = m.e)")
    steps.append("c AS (SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r)")
    steps.append("l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c GROUP BY label)")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)")
    return ",\n".join(steps) + "\nSELECT vec_id, code, error, label_error, codebooks_sha256 FROM c JOIN l ON c.label IS NOT DISTINCT FROM l.label, h"

ORACLE_SQL = {
    "op13_vector_codes": _codes_sql(),
    "op2_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
""",
    "op6_substring": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM o WHERE win IN (SELECT win FROM o GROUP BY win HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
x AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(x.ps), 0) AS gone, CASE WHEN x.ps IS NULL THEN array_to_string(w, ' ')
        ELSE array_to_string(list_filter(w, lambda v, j : NOT list_contains(x.ps, j)), ' ') END AS kept FROM d LEFT JOIN x ON d.doc_id = x.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM k
""",
    "op8_mix": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 1, 9) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS words FROM sized GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight FROM s),
l AS (SELECT *, 3.0 * words AS top, 3.0 * words / weight AS level FROM w),
r AS (SELECT *, row_number() OVER o AS place,
        ((SELECT sum(words) FROM s) - coalesce(sum(top) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fits
      FROM l WINDOW o AS (ORDER BY level, source NULLS LAST)),
t AS (SELECT *, least(top, (SELECT fits FROM r WHERE fits <= level ORDER BY place LIMIT 1) * weight) AS target FROM r),
q AS (SELECT source, words, target, CASE WHEN words > 0 THEN least(floor(target / words + 1e-12), 3) ELSE 0 END AS whole FROM t),
k AS (SELECT source, key, sum(size) AS here FROM sized GROUP BY ALL),
c AS (SELECT k.source, k.key, here, greatest(target - whole * words, 0) AS need,
        sum(here) OVER (PARTITION BY k.source ORDER BY k.key) AS upto
      FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source),
b AS (SELECT source, min(key) AS at FROM c WHERE upto > need GROUP BY source),
h AS (SELECT b.source, b.at + CASE WHEN (c.need - c.upto + c.here) * 2 > c.here THEN 1 ELSE 0 END AS threshold
      FROM b JOIN c ON b.source IS NOT DISTINCT FROM c.source AND b.at = c.key)
SELECT sized.doc_id, sized.size, CAST(q.words AS BIGINT) AS source_size, q.target,
       CAST(sized.size * (q.whole + CASE WHEN sized.key < coalesce(h.threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN q ON sized.source IS NOT DISTINCT FROM q.source LEFT JOIN h ON sized.source IS NOT DISTINCT FROM h.source
""",
    "op10_decontam": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS w FROM benchmark),
n AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM n),
o AS (SELECT doc_id, i, ns.n, array_to_string(list_slice(w, i, i + ns.n - 1), ' ') AS win
      FROM ns, (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x WHERE i + ns.n - 1 <= len(w)),
m AS (SELECT o.doc_id, o.i, o.n, n.item_id FROM o JOIN n ON o.n = n.n AND o.win = n.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
""",
}

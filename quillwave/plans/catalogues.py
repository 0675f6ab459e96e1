"""Queries on sources, vectors, catalogues and prompts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import slerp
from ..operators import catalogue as C
from ..operators import prompts as P
from ..operators import vectors as V
from ..session import shared_folder, table
from ..sources import assets as A
from ..sources import indexed as X
from ..sources import media as M
from ..sources.fixtures import RATE, SIGNAL_SQL, signal

PROBE = ", Soft piano: 1.5, warm pads: x, a: b: 2, , deep soundscape"


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _vec(df: DataFrame, name: str = "vector") -> DataFrame:
    """Components to 6 digits; what rounds to zero is 0.0, never -0.0 (DuckDB keeps the sign, so the SQL adds 0.0)."""
    return df.withColumn(name, F.transform(name, lambda x: F.round(x, 6)))


def _paths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select(F.col("url").alias("path"))


def _overlay(s: SparkSession, d: str) -> DataFrame:
    scanned = table(s, d, "supplier").select(F.col("s_name").alias("narrator"), F.lit("default").alias("phase"), F.concat("s_name", F.lit(".wav")).alias("audio_path"), F.lit("own").alias("transcript"))
    part = table(s, d, "part")
    name = lambda key: F.concat(F.lit("Supplier#"), F.lpad((key % 150).cast("string"), 9, "0"))
    config = part.select(name(F.col("p_partkey")).alias("narrator"), F.when(F.col("p_partkey") % 4 == 0, "default").otherwise(F.col("p_brand")).alias("phase"), F.concat(name(F.col("p_partkey") + 1), F.lit(".wav")).alias("audio_path"), F.col("p_name").alias("transcript"))
    return A.config_overlay(scanned, config, scanned.select("audio_path"))


def _budget(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.length("props") * 7).cast("long").alias("bytes"))
    return A.byte_budget_cutoff(rows, 1003)


def _pcm(s: SparkSession, d: str) -> DataFrame:
    blocks = table(s, d, "documents").select(F.col("doc_id").alias("block_id"), F.encode("text", "UTF-8").alias("pcm"))
    return A.pcm_block_ingest(blocks).groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def _chunk_ids(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s)
    A.write_chunks(signal(s, d), path, RATE)
    return s.read.parquet(path).groupBy("series_id", F.col("chunk_id").cast("long").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def _media(s: SparkSession, d: str) -> DataFrame:
    """Every 500 rows of a series as a file; of five files one is cut short and one has no known mark. Then the headers' rows."""
    path = shared_folder(s)
    files = M.wave_files(signal(s, d), RATE, 500)
    content = F.expr("CASE part % 5 WHEN 3 THEN substring(content, 1, 100) WHEN 4 THEN concat(encode('ABCD', 'UTF-8'), substring(content, 5)) ELSE content END")
    M.write_files(files, F.concat("series_id", F.lit("-"), "part", F.lit(".wav")), content, path)
    usable, broken = M.split_media(M.scan_media(s, path, "*.wav"))
    both = usable.withColumn("error", F.lit(None).cast("string")).unionByName(broken, allowMissingColumns=True)
    return both.select(A.name_parts(F.col("path"))[0].alias("stem"), "bytes", "format", "rate_hz", "channels", "bits", "frames", F.round("seconds", 6).alias("seconds"), "error")


def _stems(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s)
    A.write_stems(signal(s, d).select(F.floor(F.col("pos") / 1000).alias("job_id"), F.col("series_id").alias("stem"), "pos", "value"), path)
    return s.read.parquet(path).groupBy(F.col("job_id").cast("long").alias("job_id"), "stem").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def _indexed(s: SparkSession, d: str) -> DataFrame:
    """The stems of all jobs but the first, out of an indexed table."""
    path = shared_folder(s)
    X.write_stem_table(signal(s, d).select(F.floor(F.col("pos") / 100).alias("job_id"), F.col("series_id").alias("stem"), "pos", "value"), path)
    rows = X.read_between(s, path, low={"job_id": 1})
    return rows.groupBy("job_id", "stem").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.round(F.sum("value"), 6).alias("total"))


def _blends(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").filter("vec_id IS NOT NULL")
    k = F.col("vec_id") % 4
    weight = F.when(k == 0, 0.6).when(k == 1, 0.3).when(k == 2, 0.1).otherwise(-0.05)
    return rows.select(F.concat(F.lit("b"), F.floor(F.col("vec_id") / 4)).alias("blend"), k.alias("ordinal"), "vec_id", weight.alias("weight"))


def _embeddings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", "embedding")


def _slerp(s: SparkSession, d: str) -> DataFrame:
    e = _embeddings(s, d)
    pairs = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("pair"), F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("pair"), F.col("embedding").alias("b")), "pair")
    return pairs.select("pair", slerp(F.col("a"), F.col("b"), F.lit(0.3)).alias("vector"))


def _presets(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select("label", "vec_id").filter("label IS NOT NULL")
    return rows.select(F.concat(F.lit("preset"), "label").alias("preset"), F.col("vec_id").alias("ordinal"), F.col("vec_id").cast("string").alias("id"), (1.0 / (F.col("vec_id") + 1)).alias("weight"), F.when(F.col("label") == 2, "extrapolation").otherwise("slerp").alias("method"))


def _specs(s: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    spec = F.when(v % 3 == 0, F.concat(F.lit("preset"), F.col("label"))).when(v % 3 == 1, F.concat_ws(", ", v, v + 1, v + 2)).otherwise(v.cast("string"))
    return table(s, d, "embeddings").select(spec.alias("spec")).distinct()


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return V.resolve_spec(_specs(s, d), _presets(s, d))


def _audio(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stem, ext = A.name_parts(F.col("url"))
    rows = table(s, d, "pages").select(stem.alias("stem"), ext.alias("ext"), F.col("url").alias("path"), "page_id")
    texts = rows.select("stem", F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("t"), "page_id")).alias("text"), "page_id").filter("page_id % 2 = 0").drop("page_id")
    return rows.filter("ext = 'html'").select("stem", "path"), texts


def _requests(s: SparkSession, d: str) -> DataFrame:
    requests = table(s, d, "orders").select((F.col("o_custkey") * 2).cast("string").alias("slug")).distinct()
    return C.missing_requests(requests, table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("slug")))


def _labels(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    stem = F.concat(F.lit("some_author-"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", C.asset_label(stem).alias("label"), C.minutes_label(F.col("p_retailprice")).alias("length"))


def _prompts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("prompt_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(PROBE)).alias("text"))


def _jobs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_totalprice") / 500).alias("duration_sec"))


STEM = r"regexp_replace(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '\.[^.]*$', '')"
EXT = r"lower(regexp_extract(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '\.([^.]*)$', 1))"
BLENDS = "WITH bl AS (SELECT 'b' || (vec_id // 4) AS blend, vec_id % 4 AS ordinal, embedding, CASE vec_id % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.3 WHEN 2 THEN 0.1 ELSE -0.05 END AS weight FROM embeddings WHERE vec_id IS NOT NULL), l AS (SELECT blend, ordinal, weight, unnest(range(0, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM bl)"
_PRESETS = "p AS (SELECT 'preset' || label AS preset, vec_id AS ordinal, CAST(vec_id AS VARCHAR) AS id, 1.0 / (vec_id + 1) AS weight, CASE WHEN label = 2 THEN 'extrapolation' ELSE 'slerp' END AS method FROM embeddings WHERE label IS NOT NULL)"
RESOLVED = f"WITH {_PRESETS}, sp AS (SELECT DISTINCT CASE vec_id % 3 WHEN 0 THEN 'preset' || label WHEN 1 THEN concat_ws(', ', vec_id, vec_id + 1, vec_id + 2) ELSE CAST(vec_id AS VARCHAR) END AS spec FROM embeddings), o AS (SELECT spec, string_split(spec, ',') AS ids FROM sp WHERE spec NOT IN (SELECT preset FROM p)), res AS (SELECT spec, ordinal, id, weight, method FROM sp JOIN p ON spec = preset UNION ALL SELECT spec, unnest(range(0, len(ids))), trim(unnest(ids)), 1.0 / len(ids), CASE WHEN len(ids) > 1 THEN 'slerp' ELSE 'single' END FROM o)"
PAIRS = f"WITH r AS (SELECT {STEM} AS stem, {EXT} AS ext, url AS path, page_id FROM pages), a AS (SELECT stem, path FROM r WHERE ext = 'html'), t AS (SELECT stem, CASE WHEN page_id % 3 = 0 THEN '' ELSE 't' || page_id END AS text FROM r WHERE page_id % 2 = 0)"
PROMPTS = f"WITH pr AS (SELECT doc_id AS prompt_id, coalesce(text, '') || '{PROBE}' AS text FROM documents), q AS (SELECT prompt_id, list_filter(list_transform(string_split(text, ','), lambda x : regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x : x <> '') AS a FROM pr), w AS (SELECT prompt_id, unnest(range(0, len(a))) AS ordinal, unnest(a) AS part FROM q), terms AS (SELECT prompt_id, CAST(ordinal AS INT) AS ordinal, CASE WHEN part LIKE '%:%' THEN trim(regexp_extract(part, '(?s)^(.*):(.*)$', 1)) ELSE part END AS term, CASE WHEN part LIKE '%:%' THEN coalesce(TRY_CAST(trim(regexp_extract(part, '(?s)^(.*):(.*)$', 2)) AS DOUBLE), 1.0) ELSE 1.0 END AS weight FROM w)"
_TAGS = "['" + "','".join(P.BASE_TAGS) + "']"
_CAPTION = "[" + ", ".join("{'tag': '" + t + "', 'words': ['" + "','".join([w for w in t.split() if len(w) > 3] or ["\u0001"]) + "']}" for t in P.CAPTION_TAGS) + "]"
_LIST = lambda names: "['" + "','".join(names) + "']"

QUERIES = {
    "scan_assets": (lambda s, d: A.scan_assets(_paths(s, d), ["html"]), f"SELECT url AS path, {STEM} AS stem, {EXT} AS ext FROM pages WHERE {EXT} = 'html'"),
    "skip_bad_assets": (
        lambda s, d: (lambda both: both[0].withColumn("accepted", F.lit(True)).unionByName(both[1].withColumn("accepted", F.lit(False))).select("page_id", "accepted"))(A.skip_bad_assets(table(s, d, "pages"), "html", (F.length("html") > 2000) & F.col("html").contains("</article>"))),
        "SELECT page_id, coalesce(len(html) > 2000 AND html LIKE '%</article>%', false) AS accepted FROM pages",
    ),
    "media_headers": (
        _media,
        f"WITH {SIGNAL_SQL}, p AS (SELECT series_id, pos // 500 AS part, max(pos) % 500 + 1 AS n FROM signal GROUP BY 1, 2), e AS (SELECT *, CASE WHEN part % 5 = 4 THEN 'unknown format' WHEN part % 5 = 3 AND 44 + 2 * n > 100 THEN 'truncated' END AS error FROM p) SELECT series_id || '-' || part AS stem, CASE WHEN part % 5 = 3 THEN least(44 + 2 * n, 100) ELSE 44 + 2 * n END AS bytes, CASE WHEN error IS NULL THEN 'wav' END AS format, CASE WHEN error IS NULL THEN 100.0 END AS rate_hz, CASE WHEN error IS NULL THEN 1 END AS channels, CASE WHEN error IS NULL THEN 16 END AS bits, CASE WHEN error IS NULL THEN n END AS frames, CASE WHEN error IS NULL THEN round(n / 100.0, 6) END AS seconds, error FROM e",
    ),
    "config_overlay": (
        _overlay,
        "WITH a AS (SELECT s_name AS narrator, 'default' AS phase, s_name || '.wav' AS audio_path, 'own' AS transcript FROM supplier), c AS (SELECT 'Supplier#' || lpad(CAST(p_partkey % 150 AS VARCHAR), 9, '0') AS narrator, CASE WHEN p_partkey % 4 = 0 THEN 'default' ELSE p_brand END AS phase, 'Supplier#' || lpad(CAST((p_partkey + 1) % 150 AS VARCHAR), 9, '0') || '.wav' AS audio_path, p_name AS transcript FROM part), u AS (SELECT *, 0 AS layer FROM a UNION ALL SELECT *, 1 FROM c WHERE audio_path IN (SELECT audio_path FROM a)), n AS (SELECT *, row_number() OVER (PARTITION BY narrator, phase ORDER BY layer DESC, audio_path, transcript) AS n FROM u) SELECT narrator, phase, audio_path, transcript FROM n WHERE n = 1",
    ),
    "pcm_block_ingest": (
        _pcm,
        "WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), f AS (SELECT doc_id, h, unnest(range(0, len(h) // 8)) AS f FROM h), b AS (SELECT doc_id, CAST('0x' || substr(h, f * 8 + 3, 2) || substr(h, f * 8 + 1, 2) AS INT) AS l, CAST('0x' || substr(h, f * 8 + 7, 2) || substr(h, f * 8 + 5, 2) AS INT) AS r FROM f), v AS (SELECT doc_id, (l - CASE WHEN l > 32767 THEN 65536 ELSE 0 END + r - CASE WHEN r > 32767 THEN 65536 ELSE 0 END) / 2.0 / 32768 AS value FROM b) SELECT doc_id AS block_id, count(*) AS n, round(sum(value), 6) AS total FROM v GROUP BY 1 UNION ALL SELECT doc_id, 48000, 0.0 FROM h WHERE h = ''",
    ),
    "byte_budget_cutoff": (_budget, "WITH e AS (SELECT user_id AS session, event_id AS seq, len(props) * 7 AS bytes, coalesce(sum(len(props) * 7) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) SELECT session, seq, bytes, CAST(greatest(least(bytes, 1000 - before), 0) AS BIGINT) AS kept FROM e WHERE before < 1003"),
    "write_chunks": (_chunk_ids, f"WITH {SIGNAL_SQL} SELECT series_id, pos // 2000 AS chunk_id, count(*) AS n, min(pos) AS first_pos FROM signal GROUP BY 1, 2"),
    "write_stems": (_stems, f"WITH {SIGNAL_SQL} SELECT pos // 1000 AS job_id, series_id AS stem, count(*) AS n, round(sum(value), 6) AS total FROM signal GROUP BY 1, 2"),
    "indexed_stems": (_indexed, f"WITH {SIGNAL_SQL} SELECT pos // 100 AS job_id, series_id AS stem, count(*) AS n, min(pos) AS first_pos, round(sum(value), 6) AS total FROM signal WHERE pos // 100 >= 1 GROUP BY 1, 2"),
    "blend_vectors": (lambda s, d: _vec(V.blend_vectors(_blends(s, d), _embeddings(s, d))), BLENDS + ", s AS (SELECT blend, dim, round(sum(weight * x), 6) + 0.0 AS x FROM l GROUP BY 1, 2) SELECT blend, list(x ORDER BY dim) AS vector FROM s GROUP BY 1"),
    "slerp_pair": (lambda s, d: _vec(_slerp(s, d)), "WITH p AS (SELECT a.vec_id AS pair, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0), w AS (SELECT *, acos(greatest(least(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 1), -1)) AS o FROM p) SELECT pair, list_transform(range(1, len(a) + 1), lambda i : round(CASE WHEN abs(sin(o)) < 1e-6 THEN 0.7 * a[i] + 0.3 * b[i] ELSE sin(0.7 * o) / sin(o) * a[i] + sin(0.3 * o) / sin(o) * b[i] END, 6) + 0.0) AS vector FROM w"),
    "slerp_blend": (
        lambda s, d: _vec(V.slerp_blend(_blends(s, d), _embeddings(s, d))),
        "WITH RECURSIVE i AS MATERIALIZED (SELECT 'b' || (vec_id // 4) AS blend, row_number() OVER (PARTITION BY vec_id // 4 ORDER BY vec_id % 4) - 1 AS k, CASE vec_id % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.3 WHEN 2 THEN 0.1 ELSE -0.05 END::DOUBLE AS w, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL), r AS (SELECT blend, k, w AS s, e AS v FROM i WHERE k = 0 UNION ALL SELECT blend, k, s, list_transform(range(1, len(v) + 1), lambda j : CASE WHEN abs(sin(o)) < 1e-6 THEN (1 - t) * v[j] + t * e[j] ELSE sin((1 - t) * o) / sin(o) * v[j] + sin(t * o) / sin(o) * e[j] END) FROM (SELECT i.blend, i.k, r.s + i.w AS s, i.w / (r.s + i.w) AS t, r.v, i.e, acos(greatest(least(list_dot_product(v, e) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(e, e))), 1), -1)) AS o FROM r JOIN i ON i.blend = r.blend AND i.k = r.k + 1)) SELECT blend, list_transform(v, lambda x : round(x, 6) + 0.0) AS vector FROM r QUALIFY row_number() OVER (PARTITION BY blend ORDER BY k DESC) = 1",
    ),
    "extrapolate_blend": (lambda s, d: _vec(V.extrapolate_blend(_blends(s, d), _embeddings(s, d))), BLENDS + ", s AS (SELECT blend, dim, sum(weight * x) AS x, sum(x * x) FILTER (WHERE ordinal = top) AS own FROM (SELECT *, min(ordinal) OVER (PARTITION BY blend) AS top FROM l) GROUP BY 1, 2), n AS (SELECT blend, CASE WHEN sqrt(sum(own)) > 1e-6 AND sqrt(sum(x * x)) > 1e-6 THEN sqrt(sum(own)) / sqrt(sum(x * x)) ELSE 1.0 END AS k FROM s GROUP BY 1) SELECT s.blend, list(round(x * k, 6) + 0.0 ORDER BY dim) AS vector FROM s JOIN n ON s.blend = n.blend GROUP BY 1"),
    "jitter_vectors": (lambda s, d: V.jitter_vectors(_embeddings(s, d)), None),
    "resolve_spec": (lambda s, d: _r(_resolved(s, d), "weight"), RESOLVED + " SELECT spec, ordinal, id, round(weight, 6) AS weight, method FROM res"),
    "any_member": (lambda s, d: V.any_member(_resolved(s, d), table(s, d, "embeddings").filter("label = 1").select(F.col("vec_id").cast("string").alias("id"))), RESOLVED + " SELECT spec, bool_or(id IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings WHERE label = 1)) AS member FROM res GROUP BY 1"),
    "pair_assets": (lambda s, d: C.pair_assets(*_audio(s, d)), PAIRS + " SELECT a.stem, a.path, t.text FROM a JOIN t ON a.stem = t.stem WHERE t.text <> ''"),
    "unpaired_assets": (lambda s, d: C.unpaired_assets(*_audio(s, d)), PAIRS + " SELECT stem, path FROM a WHERE stem NOT IN (SELECT stem FROM t WHERE text <> '')"),
    "default_asset": (lambda s, d: C.default_asset(table(s, d, "supplier"), "s_name"), "SELECT min(s_name) AS slug FROM supplier"),
    "missing_requests": (_requests, "SELECT DISTINCT CAST(o_custkey * 2 AS VARCHAR) AS slug, (SELECT count(*) FROM customer) AS n_available, (SELECT min(CAST(c_custkey AS VARCHAR)) FROM customer) AS first_available FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)"),
    "asset_label": (_labels, "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w : upper(w[1]) || lower(w[2:])), ' ') AS label, CAST(CAST(round_even(p_retailprice, 0) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(round_even(p_retailprice, 0) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS length FROM part"),
    "sorted_catalogue": (lambda s, d: C.sorted_catalogue(_labels(s, d)).select("p_partkey", "label"), "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w : upper(w[1]) || lower(w[2:])), ' ') AS label FROM part"),
    "parse_weighted_prompts": (lambda s, d: P.parse_weighted_prompts(_prompts(s, d)), PROMPTS + " SELECT * FROM terms"),
    "merge_base_tags": (lambda s, d: P.merge_base_tags(_prompts(s, d)), PROMPTS + f", b0 AS (SELECT prompt_id, list_filter({_TAGS}, lambda t : NOT contains(lower(text), lower(t))) AS tags FROM pr), b AS (SELECT prompt_id, CAST(unnest(range(0, len(tags))) AS INT) AS ordinal, unnest(tags) AS term, 0.6 AS weight FROM b0) SELECT * FROM b UNION ALL SELECT prompt_id, ordinal + 6, term, weight FROM terms"),
    "build_caption": (lambda s, d: _prompts(s, d).select("prompt_id", P.build_caption(F.col("text")).alias("caption")), PROMPTS + f", k AS (SELECT prompt_id, text, list_transform(list_filter({_CAPTION}, lambda t : len(list_filter(t.words, lambda w : contains(lower(text), w))) = 0), lambda t : t.tag) AS tags FROM pr) SELECT prompt_id, array_to_string(list_concat(list_append(tags, regexp_replace(text, '^\\s+|\\s+$', '', 'g')), CASE WHEN contains(lower(text), 'no vocal') OR contains(lower(text), 'instrumental') THEN [] ELSE ['{P.SUFFIX}'] END), ', ') AS caption FROM k"),
    "section_template": (lambda s, d: P.section_template(_jobs(s, d)), f"WITH j AS (SELECT o_orderkey AS job_id, CASE WHEN o_totalprice / 500 <= 90 THEN {_LIST(P.SHORT)} WHEN o_totalprice / 500 <= 300 THEN {_LIST(P.MEDIUM)} ELSE {_LIST(P.LONG)} END AS s FROM orders) SELECT job_id, CAST(unnest(range(0, len(s))) AS INT) AS ordinal, unnest(s) AS section FROM j"),
}

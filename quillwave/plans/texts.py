"""Queries on texts and sentences, with their SQL. A probe line with every rule's words is put behind each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import sentences as N
from ..session import spread, table

PROBE = " Wait 30 sec vs 5 min, i.e 432 Hz; 4-7-8 or 120045: well-being -- yes... Om and chakra. YOU are here, do not stop. Now breathe in the warmth and feel your calm as you exhale"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(PROBE)).alias("text"))


def _column(change, name: str = "text"):
    return lambda s, d: _docs(s, d).select("doc_id", change(F.col("text")).alias(name))


DOCS = f"WITH docs AS (SELECT doc_id, coalesce(text, '') || '{PROBE}' AS text FROM documents)"
_EDGE = r"[^\p{L}\p{N}_]"


def _words(pairs, times: int = 2) -> str:
    """Whole-word replacement without lookaround: the characters on either side are kept; twice, as neighbours share one."""
    out = "text"
    for word, new in pairs:
        for _ in range(times):
            out = f"regexp_replace({out}, '(^|{_EDGE}){word}($|{_EDGE})', '\\1{new.replace(chr(39), chr(39) * 2)}\\2', 'gi')"
    return out


_UNITS = "['" + "','".join(R.UNITS) + "']"
_TENS = "['" + "','".join(R.TENS) + "']"
_SMALL = f"CASE WHEN i % 100 < 20 THEN {_UNITS}[i % 100 + 1] ELSE {_TENS}[i % 100 // 10 + 1] || CASE WHEN i % 10 > 0 THEN '-' || {_UNITS}[i % 10 + 1] ELSE '' END END"
_NUMBERS = DOCS + rf""", w AS (SELECT i, CASE WHEN i >= 100 THEN {_UNITS}[i // 100 + 1] || ' hundred' || CASE WHEN i % 100 > 0 THEN ' and ' ELSE '' END ELSE '' END || {_SMALL} AS said FROM (SELECT unnest(range(0, 1000)) AS i)),
marked AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '(^|{_EDGE})(\d{{1,6}})($|{_EDGE})', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), '(^|[^\p{{L}}\p{{N}}_\x01])(\d{{1,6}})($|[^\p{{L}}\p{{N}}_\x01])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), chr(1)) AS p FROM docs),
parts AS (SELECT doc_id, unnest(range(0, len(p))) AS k, unnest(p) AS t FROM marked),
said AS (SELECT doc_id, k, CASE WHEN k % 2 = 0 THEN t WHEN CAST(t AS INT) = 0 THEN 'zero' ELSE concat_ws(' ', CASE WHEN CAST(t AS INT) >= 1000 THEN h.said || ' thousand' END, CASE WHEN CAST(t AS INT) % 1000 > 0 THEN l.said END) END AS t
 FROM parts LEFT JOIN w l ON k % 2 = 1 AND TRY_CAST(t AS INT) % 1000 = l.i LEFT JOIN w h ON k % 2 = 1 AND TRY_CAST(t AS INT) // 1000 = h.i)
SELECT doc_id, string_agg(t, '' ORDER BY k) AS text FROM said GROUP BY doc_id"""

_RANGE = r"\d+(?:-\d+)+"
_RANGES = _NUMBERS[: _NUMBERS.index("marked AS")] + rf"""marked AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '(^|{_EDGE})({_RANGE})($|{_EDGE})', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), '(^|[^\p{{L}}\p{{N}}_\x01])({_RANGE})($|[^\p{{L}}\p{{N}}_\x01])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), chr(1)) AS p FROM docs),
parts AS (SELECT doc_id, unnest(range(0, len(p))) AS k, unnest(p) AS t FROM marked), lists AS (SELECT doc_id, k, CASE WHEN k % 2 = 1 THEN string_split(t, '-') ELSE [t] END AS x FROM parts),
each_ AS (SELECT doc_id, k, unnest(range(0, len(x))) AS j, unnest(x) AS t FROM lists), plain AS (SELECT doc_id, k, j, CASE WHEN k % 2 = 1 THEN regexp_replace(t, '^0+(\d+)$', '\1') ELSE t END AS t, k % 2 = 1 AND len(regexp_replace(t, '^0+(\d+)$', '\1')) <= 6 AS told FROM each_),
said AS (SELECT doc_id, k, j, CASE WHEN NOT told THEN t WHEN CAST(t AS INT) = 0 THEN 'zero' ELSE concat_ws(' ', CASE WHEN CAST(t AS INT) >= 1000 THEN h.said || ' thousand' END, CASE WHEN CAST(t AS INT) % 1000 > 0 THEN l.said END) END AS t
 FROM plain LEFT JOIN w l ON told AND TRY_CAST(t AS INT) % 1000 = l.i LEFT JOIN w h ON told AND TRY_CAST(t AS INT) // 1000 = h.i), ranges AS (SELECT doc_id, k, string_agg(t, ', ' ORDER BY j) AS t FROM said GROUP BY 1, 2)
SELECT doc_id, string_agg(t, '' ORDER BY k) AS text FROM ranges GROUP BY doc_id"""

_SENTENCES = r"""s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x : trim(x) <> '') AS a FROM docs),
r AS (SELECT doc_id, CAST(unnest(range(0, len(a))) AS INT) AS sent_no, unnest(a) AS sentence FROM s)"""
_N = r"len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda w : w <> ''))"


def _stressed() -> str:
    """Marks where no bracket stands before the word; the characters on either side are kept, twice."""
    out = "text"
    for words, mark in ((R.LESS_STRESS, "-1"), (R.MORE_STRESS, "+1")):
        for word in words:
            for _ in range(2):
                out = rf"regexp_replace({out}, '(^|[^\p{{L}}\p{{N}}_\[])({word})($|{_EDGE})', '\1[\2]({mark})\3', 'gi')"
    return out


def _count(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w : w <> ''))"


def _reduced(source: str, fields: dict[str, str], step: str) -> str:
    """A left fold over the list `source`: each text is x.s, what is carried are the `fields` of p, with the values they begin with."""
    state = lambda text: "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + f", 's': {text}}}"
    return f"list_reduce(list_prepend({state(chr(39) * 2)}, list_transform({source}, lambda s : {state('s')})), lambda p, x : {step})"


_OUT = "[]::VARCHAR[]"
# carry: the short ones so far; n: sentences left
_MERGED = _SENTENCES + ", f AS (SELECT doc_id, " + _reduced("a", {"out": _OUT, "carry": "''", "n": "len(a)"}, "list_transform([CASE WHEN p.carry <> '' THEN p.carry || ' ' || x.s ELSE x.s END], lambda j : CASE WHEN " + _count("j") + " < 4 AND (p.n > 1 OR p.carry <> '') THEN {'out': p.out, 'carry': j, 'n': p.n - 1, 's': ''} ELSE {'out': list_append(p.out, j), 'carry': '', 'n': p.n - 1, 's': ''} END)[1]") + " AS r FROM s), merged AS (SELECT doc_id, CASE WHEN r.carry = '' THEN r.out WHEN len(r.out) = 0 THEN [r.carry] ELSE list_append(r.out[:-2], r.out[-1] || ' ' || r.carry) END AS m FROM f)"
_TOKENS = "CAST(floor(" + _count("x.s") + " * 1.3) AS BIGINT)"
_CLOSED = "CASE WHEN p.held = '' THEN p.out ELSE list_append(p.out, p.held) END"
_PIECES = r"list_transform([list_filter(regexp_split_to_array(x.s, '\s+'), lambda w : w <> '')], lambda w : list_transform(range(0, (len(w) - 1) // 307 + 1), lambda i : array_to_string(w[i * 307 + 1 : i * 307 + 307], ' ')))[1]"
_PACKED = _reduced("m", {"out": _OUT, "held": "''", "n": "0::BIGINT"}, f"list_transform([{_TOKENS}], lambda t : CASE WHEN t > {R.CEILING_TOKENS} THEN {{'out': list_concat({_CLOSED}, {_PIECES}), 'held': '', 'n': 0, 's': ''}} WHEN p.held <> '' AND p.n + t > {R.CHUNK_TOKENS} THEN {{'out': {_CLOSED}, 'held': x.s, 'n': t, 's': ''}} ELSE {{'out': p.out, 'held': CASE WHEN p.held = '' THEN x.s ELSE p.held || ' ' || x.s END, 'n': p.n + t, 's': ''}} END)[1]")


# what carries on: words since the last end or breath
_ENDS = r"regexp_matches(x.s, '[,.!?\n]')"
_JOINS = "lower(x.s) IN ('" + "','".join(R.BREATH_CONJUNCTIONS) + "')"
_IS_WORD = r"regexp_matches(x.s, '^[\p{L}\p{N}\p{M}_][\p{L}\p{N}\p{M}_''-]*$')"
_BREATHS = DOCS + r", k AS (SELECT doc_id, regexp_extract_all(text, '\s+|\S+') AS m FROM docs), f AS (SELECT doc_id, " + _reduced(
    "m", {"out": "''", "n": "0::BIGINT"},
    f"CASE WHEN {_ENDS} THEN {{'out': p.out || x.s, 'n': 0, 's': ''}} WHEN NOT {_IS_WORD} THEN {{'out': p.out || x.s, 'n': p.n, 's': ''}} WHEN p.n >= {R.BREATH_WORDS} AND {_JOINS} THEN {{'out': p.out || ', ' || x.s, 'n': 1, 's': ''}} ELSE {{'out': p.out || x.s, 'n': p.n + 1, 's': ''}} END",
) + " AS r FROM k) SELECT doc_id, r.out AS text FROM f"


_WORD = r"[\p{L}\p{M}\p{N}_]"
_PHRASES = [f"as (?:you|we) (?:{'|'.join(R.VERBS)})", rf"(?:{'|'.join(R.GERUNDS)}) {_WORD}", f"with each (?:{'|'.join(R.BREATH_NOUNS)})"]
_CONJ = "|".join(R.CLAUSE_CONJUNCTIONS)


def _punctuated() -> str:
    """The comma rules without lookaround: chr(2) marks where sentences start; runs of white space are taken with what stands before them, twice."""
    opener = f"((?:{'|'.join(R.OPENERS)}) (?:{'|'.join(R.OPENER_WORDS)}) {_WORD}+"
    out = r"regexp_replace(text, '([A-Za-z])\s*$', '\1.')"
    out = rf"regexp_replace({out}, '(^|[.!?] )', '\1' || chr(2), 'g')"
    out = rf"regexp_replace({out}, '\x02Now ([a-z])', chr(2) || 'Now, \1', 'g')"
    out = rf"regexp_replace({out}, '\x02{opener})([^,.!?\p{{L}}\p{{M}}\p{{N}}_])', '\1,\2', 'g')"
    out = rf"regexp_replace({out}, '\x02{opener})({_WORD})([,.!?]|$)', '\1,\2\3', 'g')"
    out = f"replace({out}, chr(2), '')"
    for phrase in _PHRASES:
        for _ in range(2):
            out = rf"regexp_replace({out}, '(^|[^,\s]|,\s)\s+({phrase})', '\1, \2', 'gi')"
    return out


_CLAUSE = r"regexp_extract(regexp_replace(q, '(?s)^.*[,.\n]', ''), '(?s)[A-Za-z].*')"
_LONG = r"len(list_filter(regexp_split_to_array(regexp_replace(c, '(?s)^.*[!?]', ''), '\s+'), lambda w : w <> ''))"
_PIECES_OF = "text"
for _ in range(2):  # neighbours share a letter; the space stays before the mark, so that in a run of conjunctions each is still seen
    _PIECES_OF = f"regexp_replace({_PIECES_OF}, ' ({_CONJ}) (\\x01?[a-z])', ' ' || chr(1) || '\\1 \\2', 'g')"
_CLAUSES = DOCS + f", k AS (SELECT doc_id, string_split({_PIECES_OF}, ' ' || chr(1)) AS m FROM docs), f AS (SELECT doc_id, " + _reduced(
    "m", {"out": "''", "taken": "0", "joint": "''"},
    f"CASE WHEN p.taken = 1 AND x.s IN ('{_CONJ.replace('|', chr(39) + ', ' + chr(39))}') THEN {{'out': p.out || p.joint || x.s, 'taken': 2, 'joint': ' ', 's': ''}} ELSE "
    f"list_transform(list_transform([CASE p.taken WHEN 1 THEN regexp_replace(x.s, '^(?:{_CONJ}) [a-z]', '') WHEN 2 THEN x.s[2:] WHEN 3 THEN 'x ' || x.s ELSE x.s END], lambda q : {_CLAUSE}), "
    f"lambda c : {{'out': p.out || p.joint || x.s, 'taken': CASE len(c) WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 1 END, 'joint': CASE WHEN len(c) > 1 AND {_LONG} >= {R.CLAUSE_WORDS} THEN ', ' ELSE ' ' END, 's': ''}})[1] END",
) + " AS r FROM k) SELECT doc_id, r.out AS text FROM f"
_TIDY = DOCS + r" SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ',\s*,', ',', 'g'), ',(\s*[.!?])', '\1', 'g'), ' {2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM docs"
_SENSORY = DOCS + rf" SELECT doc_id, regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_,.!?—])({'|'.join(R.DETERMINERS)})\s+({'|'.join(sorted(R.SENSORY))})\b', '\1\2... \3', 'gi') AS text FROM docs"
_VARIED = DOCS + rf""", m AS (SELECT doc_id, text, regexp_extract(text, '([^\n]), ({'|'.join(R.VARIED_CONJUNCTIONS)}) {_WORD}', ['before', 'conj']) AS g, regexp_extract(text, '[^\n], (?:{'|'.join(R.VARIED_CONJUNCTIONS)}) {_WORD}') AS m FROM docs),
 h AS (SELECT doc_id, text, g.conj AS conj, m, CASE WHEN m <> '' THEN text[:strpos(text, m)] ELSE '' END AS head FROM m)
 SELECT doc_id, CASE WHEN m <> '' AND len(list_filter(regexp_split_to_array(regexp_replace(head, '(?s)^.*[.!?\n]', ''), '\s+'), lambda w : w <> '')) >= {R.VARIED_WORDS}
  THEN head || '. ' || upper(conj[1]) || conj[2:] || text[len(head) + 3 + len(conj):] ELSE text END AS text FROM h"""
_FINISHED = DOCS + rf" SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '({_WORD})\s*(\[pause:)', '\1... \2', 'g'), '\.{{2,}}', '...', 'g'), ' {{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM docs"


def _chain(*queries: str) -> str:
    """Each query over the texts of the one before it."""
    steps = [queries[0]]
    for q in queries[1:]:
        steps.append(q.replace(DOCS, f"WITH docs AS (SELECT doc_id, text FROM step{len(steps)})", 1))
    return "WITH " + ", ".join(f"step{i} AS ({q})" for i, q in enumerate(steps, 1)) + f" SELECT doc_id, text FROM step{len(steps)}"


def _by_chars(most: int, full_stop: bool) -> str:
    close = lambda x: f"CASE WHEN {x} <> '' AND NOT regexp_matches({x}, '[.!?…]$') THEN {x} || '.' ELSE {x} END" if full_stop else x
    fold = _reduced("a", {"out": _OUT, "held": "''"}, f"CASE WHEN p.held <> '' AND len(p.held) + 1 + len(x.s) > {most} THEN {{'out': list_append(p.out, p.held), 'held': x.s, 's': ''}} ELSE {{'out': p.out, 'held': CASE WHEN p.held = '' THEN x.s ELSE p.held || ' ' || x.s END, 's': ''}} END")
    return DOCS + rf""", b AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM docs), c AS (SELECT doc_id, string_split(regexp_replace({close('t')}, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)) AS a FROM b),
 f AS (SELECT doc_id, {fold} AS r FROM c), g AS (SELECT doc_id, list_transform(list_append(r.out, r.held), lambda h : {close('h')}) AS m FROM f) SELECT doc_id, CAST(unnest(range(0, len(m))) AS INT) AS chunk_no, unnest(m) AS chunk FROM g"""


def _folded(spark: SparkSession, d: str, change) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(change(F.col("text"))).alias("chunk_no", "chunk"))


def _by_tokens(text: Column) -> Column:
    return N.chunk_by_tokens(N.merge_short_sentences(N.sentence_array(text)))


QUERIES = {
    "expand_abbreviations": (_column(X.expand_abbreviations), f"{DOCS} SELECT doc_id, {_words(R.ABBREVIATIONS)} AS text FROM docs"),
    "expand_number_ranges": (_column(X.expand_number_ranges), _RANGES),
    "expand_integers": (_column(X.expand_integers), _NUMBERS),
    "normalize_punctuation": (_column(X.normalize_punctuation), DOCS + r" SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ':', ',', 'g'), '\.{2,}', '.', 'g'), '—|–|--+', ',', 'g'), '([a-zA-Z])-([a-zA-Z])', '\1\2', 'g'), '([a-zA-Z])-([a-zA-Z])', '\1\2', 'g') AS text FROM docs"),
    "lexicon_substitute": (_column(X.respell), f"{DOCS} SELECT doc_id, {_words(R.RESPELLINGS)} AS text FROM docs"),
    "lexicon_sounds": (_column(X.mark_sounds), f"{DOCS} SELECT doc_id, {_words([(w, f'[{w}](/{s}/)') for w, s in R.SOUNDS], 1)} AS text FROM docs"),
    "contract_phrases": (_column(X.contract_phrases), f"{DOCS} SELECT doc_id, {_words(R.CONTRACTIONS)} AS text FROM docs"),
    "tag_stress_words": (_column(X.tag_stress_words), f"{DOCS} SELECT doc_id, {_stressed()} AS text FROM docs"),
    "prosody_rules": (_column(X.prosody_rules), _chain(f"{DOCS} SELECT doc_id, {_punctuated()} AS text FROM docs", _CLAUSES, _BREATHS, _TIDY)),
    "break_long_clauses": (_column(X.break_long_clauses), _CLAUSES),
    "break_breath_groups": (_column(X.break_breath_groups), _BREATHS),
    "sensory_ellipsis": (_column(X.sensory_ellipsis), _SENSORY),
    "vary_sentence_length": (_column(X.vary_sentence_length), _VARIED),
    "normalize_case_space": (
        _column(X.normalize_case_space),
        DOCS + rf""", n AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM docs),
 p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '(^|{_EDGE})([A-Z]{{2,}})($|{_EDGE})', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), '(^|[^\p{{L}}\p{{N}}_\x01])([A-Z]{{2,}})($|[^\p{{L}}\p{{N}}_\x01])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), chr(1)) AS p FROM n)
 SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i : CASE WHEN i % 2 = 0 THEN lower(p[i]) ELSE p[i] END), '') AS text FROM p""",
    ),
    "split_sentences": (lambda s, d: N.split_sentences(_docs(s, d)), f"{DOCS}, {_SENTENCES} SELECT * FROM r"),
    "merge_short_sentences": (lambda s, d: _folded(s, d, lambda t: N.merge_short_sentences(N.sentence_array(t))), f"{DOCS}, {_MERGED} SELECT doc_id, CAST(unnest(range(0, len(m))) AS INT) AS chunk_no, unnest(m) AS chunk FROM merged"),
    "estimate_tokens": (_column(N.estimate_tokens, "tokens"), DOCS + r" SELECT doc_id, CAST(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w : w <> '')) * 1.3) AS INT) AS tokens FROM docs"),
    "chunk_by_tokens": (
        lambda s, d: _folded(s, d, _by_tokens),
        f"{DOCS}, {_MERGED}, k AS (SELECT doc_id, {_PACKED} AS r FROM merged), g AS (SELECT doc_id, CASE WHEN r.held = '' THEN r.out ELSE list_append(r.out, r.held) END AS c FROM k) SELECT doc_id, CAST(unnest(range(0, len(c))) AS INT) AS chunk_no, unnest(c) AS chunk FROM g",
    ),
    "chunk_by_chars": (lambda s, d: _folded(s, d, N.chunk_by_chars), _by_chars(R.CHUNK_CHARS, True)),
    "chunk_by_chars_long": (lambda s, d: _folded(s, d, lambda t: N.chunk_by_chars(t, R.CHUNK_CHARS_LONG, False)), _by_chars(R.CHUNK_CHARS_LONG, False)),
    "annotate_speed": (
        lambda s, d: N.split_sentences(_docs(s, d)).select("doc_id", "sent_no", N.annotate_speed(F.col("sentence")).alias("speed")),
        f"{DOCS}, {_SENTENCES} SELECT doc_id, sent_no, greatest(0.9 * CASE WHEN {_N} < 6 THEN 0.88 WHEN sentence LIKE '%?' THEN 0.95 WHEN sentence LIKE '%...' OR sentence LIKE '%…' THEN 0.92 ELSE 1.0 END, 0.65) AS speed FROM r",
    ),
}
_STEPS = ["expand_abbreviations", "expand_number_ranges", "expand_integers", "contract_phrases", "lexicon_sounds", "tag_stress_words", "prosody_rules", "sensory_ellipsis", "vary_sentence_length"]
QUERIES["preprocess_text"] = (_column(X.preprocess_text), _chain(*(QUERIES[n][1] for n in _STEPS), _FINISHED))

"""The queries of the numbered operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import byte_bpe, collocations, decontaminate, host_rank, importance, jaccard_tree, license_scan, line_dedup, quality_rules, ranked_search, secret_links, substring_dedup, warc_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- 1: quality classifier ---------------------------------------------------

@register("op1_importance_sample")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.Sampler(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).selected()


# --- 2: byte-level BPE -------------------------------------------------------

@register("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


# --- 3: WARC -----------------------------------------------------------------

_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {1 + 5 * g}, 5))::INT >> {s}) & 31) + 1, 1)"
    for g in range(8) for s in (15, 10, 5, 0))

OP3 = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, url, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p),
k AS (SELECT *, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host,
             regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest FROM d),
u AS (SELECT *, CASE WHEN host = '' THEN lower(url) ELSE
        array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www[.]', ''), '.')), ',')
        || ')' || lower(CASE WHEN rest = '' THEN '/' ELSE rest END) END AS url_key FROM k)
SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, url_key,
       row_number() OVER (ORDER BY url_key, page_id) - 1 AS position
FROM u
"""


@register("op3_warc_history", OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_index.write_archives(table(spark, sf_dir, "pages"))
    merged = warc_index.merge_runs(warc_index.capture_runs(manifest))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


# --- 4: n-gram Jaccard join --------------------------------------------------

_PLAIN = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(a[i : i + 2], ' ') AS g FROM w, unnest(range(1, greatest(2, len(a) - 1))) AS r(i) WHERE len(a) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
reach AS (SELECT doc_id, doc_id AS to_id FROM w UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.to_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


@register("op4_jaccard_join", OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tree.join(table(spark, sf_dir, "documents"), size=3, percent=90).drop("text_hash")


# --- 5: secret scans ---------------------------------------------------------

def _sql_pieces(kind: str) -> str:
    pattern, group = secret_links.PATTERNS[kind]
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS source, i, length(g) AS g, length(m) AS m, length(n) AS n FROM (
        SELECT doc_id, unnest(regexp_split_to_array(t, '{p}')) AS g, unnest(regexp_extract_all(t, '{p}')) AS m,
               unnest(regexp_extract_all(t, '{p}', {group})) AS n, unnest(range(1, 1 + len(regexp_extract_all(t, '{p}')))) AS i
        FROM d WHERE regexp_matches(t, '{p}')) WHERE m IS NOT NULL"""


def _op5_sql() -> str:
    union = " UNION ALL ".join(_sql_pieces(k) for k in secret_links.PATTERNS)
    place = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(secret_links.KINDS)) + " END"
    role = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in secret_links.ROLES.items()) + " END"
    strong = ", ".join(f"'{k}'" for k in secret_links.KINDS[:3])
    scope = secret_links.SCOPE
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS ({union}),
y AS (SELECT *, sum(g + m) OVER (PARTITION BY doc_id, source ORDER BY i) AS e FROM x),
z AS (SELECT doc_id, CASE WHEN source <> 'assign' THEN source WHEN n >= {secret_links.STRONG_VALUE} THEN 'assign'
        WHEN n >= {secret_links.WEAK_VALUE} THEN 'weak_secret' END AS kind, e - m AS s, e FROM y),
f AS (SELECT *, {place} AS k, {role} AS role FROM z WHERE kind IS NOT NULL),
told AS (SELECT doc_id, kind, k, s, e FROM f WHERE kind IN ({strong}) UNION ALL
         SELECT doc_id, kind, k, s, e FROM f WHERE kind NOT IN ({strong}) AND EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id
             AND o.role <> f.role AND o.s <= f.e + {scope} AND o.e >= f.s - {scope})),
a AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
             coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 3), '') AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""


@register("op5_secret_links", _op5_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_links.scan(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, secret_links.KINDS))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long").alias(f"n_{secret_links.KINDS[k]}")
    base = F.filter("spans", lambda x: x["k"] < 3)
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


# --- 6: licence scans --------------------------------------------------------

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

def _op6_sql() -> str:
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM w, unnest(range(1, len(a) - {n - 2})) AS r(i) WHERE " + " AND ".join(
            f"a[i + {j}] = '{x}'" for j, x in enumerate(phrase.split()))
        for phrase, label in license_scan.BASE.items() for n in [len(phrase.split())])
    every = {p: (label, license_scan.BASE_WEIGHT) for p, label in license_scan.BASE.items()} | license_scan.NOTICES
    own = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, {weight} AS weight FROM j WHERE contains(t, ' {p} ')"
                             for p, (label, weight) in every.items())
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS a FROM documents),
j AS (SELECT doc_id, ' ' || array_to_string(a, ' ') || ' ' AS t FROM w),
p AS ({places}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
      FROM p GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight)::DOUBLE AS score FROM ({own}) GROUP BY doc_id)
SELECT w.doc_id, len(a)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
"""


@register("op6_license_scan", _op6_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL has the phrases; SQL can't express the tags' expressions, which tests compare (the small tables have none)."""
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("permissive")


# --- 7: quality rules --------------------------------------------------------

def _op7_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    fails = []
    for r in quality_rules.RULES:
        ratio = f"({r.top}::DOUBLE / {r.bottom})"
        sides = [f"{ratio} < {r.least}"] * (r.least is not None) + [f"{ratio} > {r.most}"] * (r.most is not None)
        fails.append(f"({r.bottom} >= {max(1, r.from_size)} AND ({' OR '.join(sides)}))")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS a,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(a[i : i + 4], ' ') AS s FROM w, unnest(range(1, len(a) - 3)) AS r(i)),
rep AS (SELECT doc_id, s FROM g GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN rep USING (doc_id, s), range(5) AS q(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(a)::BIGINT AS n_words, length(array_to_string(a, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(l)::BIGINT AS n_lines, len(list_filter(a, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words, length(t)::BIGINT AS text_chars
      FROM w LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {' OR '.join(fails)} AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT broken AS kept FROM v
"""


@register("op7_quality_rules", _op7_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# --- 8: substring dedup ------------------------------------------------------

OP8 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS a FROM documents),
g AS (SELECT doc_id, i, array_to_string(a[i : i + 34], ' ') AS s FROM w, unnest(range(1, len(a) - 33)) AS r(i)),
rep AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM g JOIN rep USING (s), range(35) AS q(k)),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
e AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM w),
k AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.i) AS t FROM e ANTI JOIN c USING (doc_id, i) GROUP BY e.doc_id)
SELECT w.doc_id, len(a)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@register("op8_substring_dedup", OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


# --- 9: benchmark decontamination --------------------------------------------

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS a FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS a FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(a[i : i + 9]) AS n, array_to_string(a[i : i + 9], ' ') AS s
       FROM b, unnest(range(1, greatest(2, len(a) - 8))) AS r(i) WHERE len(a) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(a[i : i + n - 1], ' ') AS s
       FROM d, (SELECT DISTINCT n FROM bw) AS k, unnest(range(1, len(a) - n + 2)) AS r(i)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(n)) AS q(k) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(a)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@register("op9_decontaminate", OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


# --- 10: URL filters ---------------------------------------------------------

def _op10_sql() -> str:
    unit, damp = host_rank.UNIT, host_rank.DAMPING
    link = host_rank.LINK.replace("'", "''")
    case = "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{}}"
        for r in sorted(host_rank.RULES, key=lambda r: (-len(r.name), r.name))) + " END"
    ordered = sorted(host_rank.RULES, key=lambda r: (-len(r.name), r.name))
    rule, verdict = (case.format(*[f"'{x}'" for x in xs]) for xs in ([r.name for r in ordered], [r.verdict for r in ordered]))
    out = [rf"""
WITH u AS (SELECT page_id, coalesce(html, '') AS html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, {rule} AS rule, {verdict} AS said FROM u),
hosts AS (SELECT DISTINCT host FROM u WHERE host <> ''),
up AS (SELECT h.host, s.host AS site FROM hosts h JOIN hosts s ON s.host = regexp_replace(h.host, '^[^.]*[.]', '') AND s.host <> h.host),
links AS MATERIALIZED (SELECT DISTINCT src, dst FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM u
    UNION ALL SELECT host, site FROM up UNION ALL SELECT site, host FROM up) WHERE src <> '' AND dst <> '' AND src <> dst)"""]
    for name, said, src, dst in (("t", "allow", "src", "dst"), ("b", "block", "dst", "src")):
        out.append(f"{name}s AS MATERIALIZED (SELECT DISTINCT host FROM j WHERE said = '{said}' AND host <> '')")
        out.append(f"{name}d AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, count(*) OVER (PARTITION BY {src}) AS n FROM links)")
        out.append(f"{name}0 AS MATERIALIZED (SELECT host, {unit}::HUGEINT AS score FROM {name}s)")
        for k in range(host_rank.ROUNDS):
            out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT host, sum(score)::HUGEINT AS score FROM (
    SELECT dst AS host, score * {damp} // (100 * n) AS score FROM {name}d JOIN {name}{k} ON src = host WHERE score * {damp} // (100 * n) > 0
    UNION ALL SELECT host, ({unit}::HUGEINT * {100 - damp}) // 100 FROM {name}s) GROUP BY host)""")
    last = host_rank.ROUNDS
    return ",\n".join(out) + f"""
SELECT j.page_id, j.host, j.path, j.rule, coalesce(said, CASE WHEN coalesce(b.score, 0) > coalesce(t.score, 0) * {host_rank.THRESHOLD}
       THEN 'block' ELSE 'allow' END) AS verdict, coalesce(t.score, 0)::VARCHAR AS trust, coalesce(b.score, 0)::VARCHAR AS distrust
FROM j LEFT JOIN t{last} t ON t.host = j.host LEFT JOIN b{last} b ON b.host = j.host
"""


@register("op10_host_rank", _op10_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores as text: they are whole numbers of up to 38 digits, for which DuckDB and Spark have different types."""
    judged = host_rank.judge(table(spark, sf_dir, "pages"))
    return judged.withColumns({c: F.col(c).cast("string") for c in ("trust", "distrust")})


# --- 11: ranked lexical search -----------------------------------------------

OP11 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS a FROM documents),
s AS (SELECT count(*) FILTER (len(a) > 0) AS n, sum(len(a))::BIGINT AS l FROM d),
t AS (SELECT doc_id, x, count(*) AS tf FROM (SELECT doc_id, unnest(a) AS x FROM d) GROUP BY ALL),
w AS (SELECT x, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY x, n),
m AS (SELECT doc_id, 50 + (50 * len(a) * n) // l AS m FROM d, s WHERE len(a) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_ALNUM}')) AS x FROM benchmark),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN t USING (x) JOIN w USING (x) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50
"""


@register("op11_ranked_search", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# --- 12: line dedup ----------------------------------------------------------

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{_UPPER}', '{_SMALL}') AS key FROM l),
r AS (SELECT key, key <> '' AND count(DISTINCT doc_id) >= 10 AS gone FROM k GROUP BY key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM k JOIN r USING (key) GROUP BY doc_id
"""


@register("op12_line_dedup", OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# --- 13: phrase collocation mining -------------------------------------------

OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS a FROM p),
n AS (SELECT lang, sum(len(a))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, array_to_string(a[i : i + k - 1], ' ') AS phrase, count(*) AS f
      FROM w, (VALUES (1), (2), (3)) AS s(k), unnest(range(1, len(a) - k + 2)) AS r(i) GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS x FROM f WHERE k > 1 AND f >= 10),
held AS (SELECT lang, array_to_string(x[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(x[2:3], ' '), a FROM c WHERE k = 3),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN held USING (lang, phrase) WHERE 100 * held.a >= 50 * c.a),
cut AS (SELECT c.lang, c.phrase, c.a, j, array_to_string(x[1:j], ' ') AS fst, array_to_string(x[j + 1:], ' ') AS rst
        FROM c ANTI JOIN gone USING (lang, phrase), unnest(range(1, k)) AS q(j)),
scored AS (SELECT cut.lang, cut.phrase, cut.a, j, l.f AS l, r.f AS r, (1000000::HUGEINT * cut.a * cut.a // (l.f::HUGEINT * r.f))::BIGINT AS score
           FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = fst JOIN f r ON r.lang = cut.lang AND r.phrase = rst),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low) JOIN n USING (lang) WHERE rank <= 2000
"""


@register("op13_collocations", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))

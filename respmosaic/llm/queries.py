"""Queries of this subpackage and their SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)`` and its SQL, if any."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: DuckDB: A-Z to a-z only.
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8_SQL = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce({LOWER.format('text')}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({LOWER.format('text')}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, lens WHERE len(w) >= n)),
m AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM t LEFT JOIN h USING (r) LEFT JOIN q USING (r)"""


@query("op8_decontaminate", OP8_SQL)
def op8(spark, sf):
    from respmosaic.llm import decontaminate

    return decontaminate.digest(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op10_byte_bpe")
def op10(spark, sf):
    from respmosaic.llm import bpe

    return bpe.digest(table(spark, sf, "documents"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
g AS (SELECT h, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
 CASE WHEN best IS NOT NULL AND coalesce(page_id < best, true) THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN best IS NOT NULL AND coalesce(page_id < best, true) THEN best END AS refers_to
FROM p LEFT JOIN g USING (h)"""


@query("op2_warc", OP2_SQL)
def op2(spark, sf):
    from respmosaic.llm import warc

    return warc.digest(table(spark, sf, "pages"))


@query("op4_toxicity")
def op4(spark, sf):
    from respmosaic.llm import toxicity

    return toxicity.digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op3_language")
def op3(spark, sf):
    from respmosaic.llm import language

    return language.digest(table(spark, sf, "documents"))


@query("op5_quality")
def op5(spark, sf):
    from respmosaic.llm import quality

    return quality.digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op6_secrets")
def op6(spark, sf):
    from respmosaic.llm import secret_scan

    return secret_scan.digest(table(spark, sf, "documents"))


_WORDS = rf"regexp_extract_all(coalesce({LOWER.format('text')}, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM u GROUP BY a),
r(node, reach) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(reach) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id) JOIN r ON r.node = t.doc_id GROUP BY ALL"""


@query("op1_ngram_join", OP1_SQL)
def op1(spark, sf):
    from respmosaic.llm import ngram_join

    return ngram_join.digest(table(spark, sf, "documents"))


@query("op9_outliers")
def op9(spark, sf):
    from respmosaic.llm import outliers

    return outliers.digest(table(spark, sf, "documents"))


#: Two hex digits a byte; texts are cut into all their 100-byte strings.
OP7_SQL = """
WITH t AS (SELECT doc_id, row_number() OVER () AS r, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
s AS (SELECT doc_id, r, i, substr(x, (2 * i + 1)::INT, 200) AS g FROM (SELECT doc_id, r, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM t WHERE length(x) >= 200)),
f AS (SELECT md5(g) AS k, min((doc_id, i)) AS head FROM s GROUP BY k),
d AS (SELECT r, i FROM s JOIN f ON md5(g) = k WHERE (doc_id, i) > head),
b AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM d),
n AS (SELECT r, sum(least(100, coalesce(i - p, 100))) AS n_removed, count(*) FILTER (WHERE p IS NULL OR i - p > 100) AS n_spans FROM b GROUP BY r),
g AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i - p > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM b),
e AS (SELECT r, k, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY r, k),
z AS (SELECT r, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM e GROUP BY r),
kept AS (SELECT r, string_agg(substr(x, (2 * a + 1)::INT, (2 * (c - a))::INT), '' ORDER BY a) AS rest FROM
 (SELECT r, x, unnest(list_concat([0], his)) AS a, unnest(list_concat(los, [length(x) // 2])) AS c FROM t JOIN z USING (r)) GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(unhex(coalesce(rest, x))) AS kept_sha256 FROM t LEFT JOIN n USING (r) LEFT JOIN kept USING (r)"""


@query("op7_repeats", OP7_SQL)
def op7(spark, sf):
    from respmosaic.llm import repeats

    return repeats.digest(table(spark, sf, "documents"))


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round spelled out: all distances, the nearest entry, floors of means (the remainder is taken off first)."""
    ctes = [
        """v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x, len(embedding) AS n
 FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, k, list_slice(x, k * (n // {parts}) + 1, (k + 1) * (n // {parts})) AS x FROM v, range({parts}) t(k))",
        f"c0 AS MATERIALIZED (SELECT k, r - 1 AS e, x AS c FROM p WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"a{i} AS MATERIALIZED (SELECT r, k, min((d, e)) AS m FROM (SELECT r, k, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d"
            f" FROM p JOIN c{i} USING (k)) GROUP BY r, k)"
        )
        if i < rounds:
            ctes.append(
                f"s{i} AS (SELECT k, e, w, sum(x[w])::HUGEINT AS s, count(*) AS n FROM (SELECT k, m[2] AS e, x, unnest(range(1, len(x) + 1)) AS w FROM a{i} JOIN p USING (r, k)) GROUP BY k, e, w),"
                f" m{i} AS (SELECT k, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY w) AS c FROM s{i} GROUP BY k, e),"
                f" c{i + 1} AS MATERIALIZED (SELECT k, e, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k, e))"
            )
    return (
        "WITH "
        + ",\n".join(ctes)
        + f""",
o AS (SELECT r, string_agg(lower(printf('%02x', m[2])), '' ORDER BY k) AS code, sum(m[1])::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN o USING (r), h"""
    )


@query("op13_vector_codes", _op13_sql())
def op13(spark, sf):
    from respmosaic.llm import vector_codes

    return vector_codes.digest(table(spark, sf, "embeddings"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all({LOWER.format('text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
z AS (SELECT lang, sum(c)::HUGEINT AS n, count(*)::HUGEINT AS v FROM k GROUP BY lang),
y AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM o GROUP BY lang, source),
q AS (SELECT lang, term, 1 + (1000000000 * (c + 1)::HUGEINT) // (n + v) AS q FROM k JOIN z USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, 1 + (1000000000 * (coalesce(o.c, 0) + 1)::HUGEINT) // (coalesce(y.n, 0) + z.v) AS p
 FROM g JOIN k ON k.lang = g.lang JOIN z ON z.lang = g.lang LEFT JOIN y ON y.lang = g.lang AND y.source = g.source LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
u AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM u QUALIFY part = 'pair' OR rank <= 200"""


@query("op12_divergence", OP12_SQL)
def op12(spark, sf):
    from respmosaic.llm import divergence

    return divergence.digest(table(spark, sf, "documents"))


@query("op11_html_text")
def op11(spark, sf):
    from respmosaic.llm import html_text

    return html_text.digest(table(spark, sf, "pages"))

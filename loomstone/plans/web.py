"""Queries over saved pages: elements, search, skeletons, meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import net
from loomstone.operators import html, meaning, retrieval
from loomstone.registry import query
from loomstone.sources.scratch import cut
from loomstone.sources.tables import table


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed once and written, since several branches read it."""
    return cut(html.page_elements(table(spark, sf_dir, "pages")), "elements")


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(retrieval.with_structure(elements(spark, sf_dir)), "structure")


#: Tags of these pages that are elements, with their kinds and depths.
_TAGS = (("nav", "navigation", 0), ("ul", "list", 1), ("li", "item", 2), ("a", "link", 3), ("article", "section", 0), ("h1", "heading", 1), ("p", "text", 1), ("footer", "footer", 0))


_KINDS_SQL = " ".join(f"WHEN '{t}' THEN '{k}'" for t, k, _ in _TAGS)
_DEPTHS_SQL = " ".join(f"WHEN '{t}' THEN {d}" for t, _, d in _TAGS)


def _decoded_sql(text: str) -> str:
    """Entities decoded."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&"), ("&amp", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


def _plain_sql(text: str) -> str:
    """Entities decoded, white space as single spaces."""
    return f"trim(regexp_replace({_decoded_sql(text)}, '\\s+', ' ', 'g'))"


def _short_sql(text: str, limit: int) -> str:
    return f"CASE WHEN length({text}) > {limit} THEN {text}[:{limit - 1}] || '…' ELSE {text} END"


@query("page_elements", f"""
WITH h AS (SELECT page_id, {_plain_sql("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title, regexp_replace(html, '<script.*?</script>|<style.*?</style>|<head.*?</head>|<!--.*?-->|<b>|</b>|<br>', '', 'gs') AS body FROM pages),
t AS (SELECT page_id, title, unnest(regexp_extract_all(body, '<(?:{"|".join(t for t, _, _ in _TAGS)})(?: [^>]*)?>[^<]*')) AS whole, generate_subscripts(regexp_extract_all(body, '<(?:{"|".join(t for t, _, _ in _TAGS)})(?: [^>]*)?>[^<]*'), 1) AS n FROM h),
e AS (SELECT page_id, title, n, regexp_extract(whole, '^<([a-z0-9]+)', 1) AS tag, regexp_extract(whole, 'href="([^"]*)"', 1) AS href, {_plain_sql("regexp_extract(whole, '>([^<]*)$', 1)")} AS own,
  {_plain_sql("split_part(regexp_replace(regexp_extract(whole, '>([^<]*)$', 1), '^\\s+', ''), chr(10), 1)")} AS first_line FROM t),
w AS (SELECT *, lead(own) OVER (PARTITION BY page_id ORDER BY n) AS next_own, lead(href) OVER (PARTITION BY page_id ORDER BY n) AS next_href, lead(own, 2) OVER (PARTITION BY page_id ORDER BY n) AS third_own,
  string_agg(CASE WHEN tag = 'a' THEN own ELSE '' END, '') OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS menu FROM e),
s AS (SELECT *, CASE tag WHEN 'nav' THEN menu WHEN 'ul' THEN '- ' || third_own WHEN 'li' THEN '[' || next_own || '](' || next_href || ')' WHEN 'article' THEN '## ' || next_own ELSE first_line END AS line,
  CASE WHEN tag IN ('a', 'h1') THEN own WHEN tag = 'li' THEN next_own ELSE '' END AS named FROM w)
SELECT page_id, title, n - 1 AS ord, 'e' || n AS element_id, CASE tag {_KINDS_SQL} END AS kind, CASE tag {_DEPTHS_SQL} END AS depth, {_short_sql("named", 80)} AS label, {_short_sql("line", 120)} AS summary,
  tag = 'a' AS clickable, CASE WHEN tag = 'a' THEN href END AS dest FROM s""")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements of all pages."""
    return html.page_elements(table(spark, sf_dir, "pages")).drop("text")


@query("page_element_kinds", """
SELECT page_id, len(regexp_extract_all(h, '<h1[ >]')) AS headings, len(regexp_extract_all(h, '<a href')) AS links,
  len(regexp_extract_all(h, '<li[ >]')) AS items, len(regexp_extract_all(h, '<p[ >]')) AS texts
FROM (SELECT page_id, regexp_replace(html, '<script.*?</script>|<style.*?</style>|<head.*?</head>|<!--.*?-->', '', 'gs') AS h FROM pages)""")
def page_element_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by kind on every page."""
    e = html.page_elements(table(spark, sf_dir, "pages"))
    n = lambda k: F.count_if(F.col("kind") == k)
    counted = e.groupBy("page_id").agg(n("heading").alias("headings"), n("link").alias("links"), n("item").alias("items"), n("text").alias("texts"))
    return table(spark, sf_dir, "pages").select("page_id").join(counted, "page_id", "left").fillna(0)


@query("page_url_rule", """
SELECT page_id, starts_with(url, 'https://') OR regexp_matches(url, '^http://(localhost|127\\.0\\.0\\.1|10\\.|192\\.168\\.)') AS allowed,
  regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages""")
def page_url_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", net.url_allowed(F.col("url")).alias("allowed"), net.url_host(F.col("url")).alias("host"))


@query("page_savings", """
WITH t AS (SELECT page_id, CAST(floor(length(html) / 4.0 + 0.5) AS BIGINT) AS raw, CAST(floor(length(url) / 4.0 + 0.5) AS BIGINT) AS kept FROM pages)
SELECT page_id, raw AS raw_tokens, kept AS kept_tokens, CASE WHEN raw > 0 THEN CAST(floor((1 - kept / raw) * 100 + 0.5) AS BIGINT) ELSE 0 END AS saved_percent, CASE WHEN raw > 0 AND kept > 0 THEN round(raw / kept, 1) END AS ratio FROM t""")
def page_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.functions.text import page_tokens

    rows = table(spark, sf_dir, "pages").select("page_id", page_tokens(F.col("html")).alias("raw_tokens"), page_tokens(F.col("url")).alias("kept_tokens"))
    saved = retrieval.savings(F.col("raw_tokens"), F.col("kept_tokens"))
    return rows.select("*", saved["percent"].alias("saved_percent"), saved["ratio"].alias("ratio"))


@query("element_structure", f"""
WITH h AS (SELECT page_id, regexp_replace(html, '<script.*?</script>|<style.*?</style>|<head.*?</head>|<!--.*?-->', '', 'gs') AS body FROM pages),
t AS (SELECT page_id, body, unnest(tags) AS tag, generate_subscripts(tags, 1) AS n FROM (SELECT page_id, body, regexp_extract_all(body, '<({"|".join(t for t, _, _ in _TAGS)})[ >]', 1) AS tags FROM h)),
e AS (SELECT page_id, n - 1 AS ord, tag, CASE tag {" ".join(f"WHEN '{t}' THEN {d}" for t, _, d in _TAGS)} END AS depth, trim(replace(replace(replace(replace(regexp_extract(body, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS title FROM t),
n AS (SELECT a.page_id, a.ord, min(b.ord) AS next_ord FROM e a JOIN e b ON a.page_id = b.page_id AND b.ord > a.ord AND b.depth <= a.depth GROUP BY 1, 2),
p AS (SELECT a.page_id, a.ord, max(b.ord) AS parent_ord FROM e a JOIN e b ON a.page_id = b.page_id AND b.ord < a.ord AND b.depth < a.depth GROUP BY 1, 2),
g AS (SELECT page_id, max(ord) AS total, min(ord) FILTER (tag = 'h1') AS h1 FROM e GROUP BY 1)
SELECT e.page_id, e.ord, coalesce(n.next_ord - 1, total) > e.ord AS has_children, coalesce(n.next_ord - 1, total) AS end_ord, parent_ord,
  CASE WHEN h1 < e.ord THEN CASE WHEN length(title) > 80 THEN title[:79] || '…' ELSE title END END AS heading
FROM e JOIN g USING (page_id) LEFT JOIN n USING (page_id, ord) LEFT JOIN p USING (page_id, ord)""")
def element_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents, subtree ends and headings of all elements."""
    return retrieval.with_structure(html.page_elements(table(spark, sf_dir, "pages"))).select("page_id", "ord", "has_children", "end_ord", "parent_ord", "heading")


def _queries(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (1, 'the thing'), (2, 'Home'), (3, 'nothing matches zzz'), (4, 'hating or things'), (5, 'contact about') AS t(query_id, query)")


#: The queries, with their words of three letters or more and the roots of these of four letters or more.
_ASKED = """(VALUES (1, 'the thing', ['the', 'thing'], CAST([] AS VARCHAR[])), (2, 'home', ['home'], ['home']), (3, 'nothing matches zzz', ['nothing', 'matches', 'zzz'], ['noth', 'match']),
  (4, 'hating or things', ['hating', 'things'], CAST([] AS VARCHAR[])), (5, 'contact about', ['contact', 'about'], ['contact', 'about'])) q(query_id, q, words, roots)"""
_STRIPPED = f"""regexp_replace({_decoded_sql("regexp_extract(whole, '>([^<]*)$', 1)")}, '^\\s+|\\s+$', '', 'g')"""
#: Every element of these pages with its place, last element below, label, first line and whole text.
_ELEMENTS = f"""
WITH h AS (SELECT page_id, regexp_replace(html, '<script.*?</script>|<style.*?</style>|<head.*?</head>|<!--.*?-->|<b>|</b>|<br>', '', 'gs') AS body FROM pages),
l AS (SELECT page_id, regexp_extract_all(body, '<(?:{"|".join(t for t, _, _ in _TAGS)})(?: [^>]*)?>[^<]*') AS found FROM h),
t AS (SELECT page_id, unnest(found) AS whole, generate_subscripts(found, 1) AS n FROM l),
e AS (SELECT page_id, n, regexp_extract(whole, '^<([a-z0-9]+)', 1) AS tag, regexp_extract(whole, 'href="([^"]*)"', 1) AS href, {_STRIPPED} AS raw FROM t),
w AS (SELECT *, CASE tag {_DEPTHS_SQL} END AS depth, lead(raw) OVER p AS next_raw, lead(href) OVER p AS next_href, lead(raw, 2) OVER p AS third_raw FROM e WINDOW p AS (PARTITION BY page_id ORDER BY n)),
g AS (SELECT page_id, max(n) AS total, string_agg(raw, '' ORDER BY n) FILTER (tag = 'a') AS menu, string_agg('- ' || raw, chr(10) ORDER BY n) FILTER (tag = 'a') AS items, string_agg(raw, chr(10) ORDER BY n) FILTER (tag = 'p' AND raw <> '') AS body FROM e GROUP BY 1),
d AS (SELECT a.page_id, a.n, min(b.n) AS next_n FROM w a JOIN w b ON a.page_id = b.page_id AND b.n > a.n AND b.depth <= a.depth GROUP BY 1, 2),
x AS (SELECT w.*, coalesce(d.next_n - 1, total) AS last_n, CASE WHEN tag IN ('a', 'h1') THEN raw WHEN tag = 'li' THEN next_raw ELSE '' END AS named,
  CASE tag WHEN 'nav' THEN menu WHEN 'ul' THEN items WHEN 'li' THEN '[' || next_raw || '](' || next_href || ')' WHEN 'article' THEN concat_ws(chr(10), '## ' || next_raw, body) ELSE raw END AS text
  FROM w JOIN g USING (page_id) LEFT JOIN d ON d.page_id = w.page_id AND d.n = w.n),
y AS (SELECT *, trim(regexp_replace(named, '\\s+', ' ', 'g')) AS clean, trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')) AS line FROM x),
v AS (SELECT *, {_short_sql("clean", 80)} AS label, {_short_sql("line", 120)} AS summary, CASE tag {_KINDS_SQL} END AS kind FROM y)"""
_LADDER = f"""{_ELEMENTS},
z AS (SELECT page_id, n, last_n, lower(label || ' ' || summary) AS head, text FROM v),
f AS (SELECT page_id, n, last_n, head || ' ' || lower(text) AS whole, CASE WHEN last_n > n THEN head ELSE head || ' ' || lower(text) END AS own FROM z),
o AS (SELECT query_id, page_id, n, last_n,
  [contains(q, ' ') AND contains(whole, q), len(words) > 1 AND len(list_filter(words, lambda v: contains(own, v))) = len(words), NOT contains(q, ' ') AND contains(whole, q), false,
   len(words) > 1 AND len(list_filter(words, lambda v: contains(whole, v))) > 0, len(list_filter(roots, lambda v: contains(whole, v))) > 0] AS hits FROM f CROSS JOIN {{asked}}),
r AS (SELECT *, list_position(hits, true) - 1 AS rung FROM o),
m AS (SELECT *, min(rung) OVER (PARTITION BY query_id, page_id) AS first FROM r WHERE rung >= 0),
k AS (SELECT *, lead(n) OVER (PARTITION BY query_id, page_id ORDER BY n) AS inner_n FROM m WHERE hits[first + 1]),
matches AS (SELECT query_id, page_id, n - 1 AS ord, 'e' || n AS element_id, ['exact phrase', 'all words', 'word', 'meaning', 'any word', 'word root'][first + 1] AS rung FROM k WHERE inner_n IS NULL OR inner_n > last_n)"""


@query("search_ladder", f"{_LADDER.format(asked=_ASKED)} SELECT * FROM matches")
def search_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rung that finds something on each page, for several queries."""
    return retrieval.search_ladder(structured(spark, sf_dir), _queries(spark))


@query("search_context", f"""{_LADDER.format(asked=_ASKED)}
SELECT DISTINCT query_id, matches.page_id, f.n - 1 AS ord FROM matches JOIN f ON f.page_id = matches.page_id AND matches.ord + 1 > f.n AND matches.ord + 1 <= f.last_n""")
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements above the matches of a search."""
    e = structured(spark, sf_dir)
    return retrieval.match_ancestors(retrieval.search_ladder(e, _queries(spark)), e)


@query("page_skeletons", f"""{_ELEMENTS},
b AS (SELECT *, tag = 'nav' AND last_n - n >= 3 AS fold, length(summary) > 5 AS useful, CASE WHEN tag = 'a' THEN ' → ' || href ELSE '' END AS target FROM v),
c AS (SELECT *, coalesce(max(CASE WHEN fold THEN last_n END) OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= n, false) AS hidden FROM b),
s AS (SELECT page_id, n, CASE WHEN fold THEN last_n - n ELSE 0 END AS below, CASE
    WHEN fold THEN '○ [e' || n || '] nav "navigation" (' || (SELECT count(*) FROM v a WHERE a.page_id = c.page_id AND a.tag = 'a' AND a.n > c.n AND a.n <= c.last_n) || ' links)'
    ELSE repeat('  ', depth) || CASE WHEN tag = 'a' THEN '● ' ELSE '○ ' END || '[e' || n || '] ' || kind || CASE WHEN label <> '' THEN ' "' || label || '"' ELSE '' END || target
      || CASE WHEN last_n = n AND useful AND summary <> label THEN chr(10) || repeat('  ', depth) || '  └ ' || summary ELSE '' END END AS line
  FROM c WHERE NOT hidden AND NOT (last_n = n AND tag <> 'a' AND label = '' AND NOT useful)),
k AS (SELECT page_id, string_agg(line, chr(10) ORDER BY n) AS skeleton, count(*) AS n_lines, CAST(sum(below) AS BIGINT) AS collapsed FROM s GROUP BY 1)
SELECT *, CAST(floor(length(skeleton) / 4.0 + 0.5) AS BIGINT) AS tokens FROM k""")
def page_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered skeleton of every page, with its tokens."""
    return retrieval.skeletons(retrieval.skeleton_lines(structured(spark, sf_dir)))


@query("page_outlines", f"""{_ELEMENTS},
m AS (SELECT page_id, n - 1 AS ord, repeat('  ', depth) || '[e' || n || '] ' || kind || CASE WHEN label <> '' THEN ' "' || label || '"' ELSE '' END AS line, 0 AS part FROM v WHERE kind IN ('heading', 'navigation', 'section', 'footer')
  UNION ALL SELECT page_id, n - 1 + 1048576, '  [e' || n || '] link "' || label || '" → ' || href, 1 FROM v WHERE tag = 'a' AND label <> ''),
b AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY page_id, part ORDER BY ord) AS used, count(*) OVER (PARTITION BY page_id, part) AS marks FROM m)
SELECT page_id, ord, line FROM b WHERE used <= 400""")
def page_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.outline(elements(spark, sf_dir), 400)


@query("embed_jobs", _ELEMENTS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
o AS (SELECT page_id, min(n) FILTER (tag = 'h1') AS h1, any_value(label) FILTER (tag = 'h1') AS heading FROM v GROUP BY 1),
j AS (SELECT CASE WHEN n > h1 THEN heading ELSE '' END AS title, text AS body, count(*) AS n_elements FROM v JOIN o USING (page_id) GROUP BY 1, 2),
k AS (SELECT n_elements, length(title) + length(body) AS size, md5(title || '|' || body) AS key FROM j),
c AS (SELECT *, CAST(('0x' || key[1]) AS INT) % 8 AS shard FROM k),
i AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY key) AS nth FROM c),
u AS (SELECT n_elements, size, shard, key, nth, size AS used, 0 AS batch FROM i WHERE nth = 1
  UNION ALL SELECT i.n_elements, i.size, i.shard, i.key, i.nth, CASE WHEN used + i.size > 24000 THEN i.size ELSE used + i.size END, CASE WHEN used > 0 AND used + i.size > 24000 THEN batch + 1 ELSE batch END
  FROM u JOIN i ON i.shard = u.shard AND i.nth = u.nth + 1)
SELECT n_elements, size, shard, key, batch FROM u""")
def embed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts to embed, batched by size."""
    jobs = retrieval.embed_jobs(structured(spark, sf_dir)).select("n_elements", (F.length("title") + F.length("body")).alias("size"), F.md5(F.concat_ws("|", "title", "body")).alias("key"))
    return retrieval.greedy_batches(jobs.withColumn("shard", F.conv(F.substring("key", 1, 1), 16, 10).cast("int") % 8), ["shard"], "key", "size", 24_000)


_COS = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"


@query("meaning_search", f"""
WITH s AS (SELECT a.vec_id AS query_id, b.label AS page_id, b.vec_id AS element_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
z AS (SELECT *, (score - avg(score) OVER w) / CASE WHEN stddev_pop(score) OVER w = 0 THEN 1 ELSE stddev_pop(score) OVER w END AS z, max(score) OVER w AS top FROM s WINDOW w AS (PARTITION BY query_id, page_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY score DESC, element_id) AS rank FROM z WHERE z >= 2.0 AND score >= top - 0.3)
SELECT query_id, page_id, element_id, round(score, 6) AS score, round(z, 5) AS z, rank FROM k WHERE rank <= 10""")
def meaning_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as a query against all others, labels as pages."""
    out = meaning.meaning_matches(*_meant(spark, sf_dir), 2.0, 0.3, skip_equal=True)
    return out.select("query_id", "page_id", "element_id", F.round("score", 6).alias("score"), F.round("z", 5).alias("z"), F.col("rank").cast("long").alias("rank"))


@query("page_similarity", f"""
WITH s AS (SELECT a.vec_id AS query_id, b.label AS page_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
SELECT query_id, page_id, round(avg(score), 6) AS mean, round(CASE WHEN stddev_pop(score) = 0 THEN 1 ELSE stddev_pop(score) END, 6) AS sd FROM s GROUP BY 1, 2""")
def page_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, asked = _meant(spark, sf_dir)
    return meaning.similarity(pages, asked, 32).select("query_id", "page_id", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def _meant(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, labels as pages, and every fiftieth as a query."""
    v = table(spark, sf_dir, "embeddings")
    pages = v.select(F.col("label").alias("page_id"), F.col("vec_id").alias("element_id"), F.col("embedding").alias("vector"))
    return pages, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("meaning_blocks", f"""
WITH s AS (SELECT a.vec_id AS query_id, b.label AS page_id, b.vec_id AS element_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0),
z AS (SELECT *, (score - avg(score) OVER w) / CASE WHEN stddev_pop(score) OVER w = 0 THEN 1 ELSE stddev_pop(score) OVER w END AS z, max(score) OVER w AS top FROM s WINDOW w AS (PARTITION BY query_id, page_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY score DESC, element_id) AS rank FROM z WHERE z >= 1.5 AND score >= top - 0.9)
SELECT query_id, page_id, element_id, round(score, 6) AS score, round(z, 5) AS z, rank FROM k WHERE rank <= 10""")
def meaning_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that stand out for every fiftieth one, by products of blocks of 32 and pages' moments."""
    out = meaning.meaning_matches(*_meant(spark, sf_dir), 1.5, 0.9, block=32)
    return out.select("query_id", "page_id", "element_id", F.round("score", 6).alias("score"), F.round("z", 5).alias("z"), F.col("rank").cast("long").alias("rank"))


@query("rerank_candidates", f"""
WITH s AS (SELECT a.vec_id AS query_id, b.label * 2 + b.vec_id % 2 AS page_id, b.vec_id // 3 AS element_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0),
e AS (SELECT query_id, page_id, element_id, max(score) AS score FROM s GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY score DESC, element_id) AS rank FROM e)
SELECT query_id, page_id, element_id, round(score, 6) AS score, rank FROM k WHERE rank <= 20""")
def rerank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty elements of every page, of up to three vectors each, for every fiftieth vector."""
    pages, asked = _meant(spark, sf_dir)
    n = F.col("element_id")
    pages = pages.select((F.col("page_id") * 2 + n % 2).alias("page_id"), F.floor(n / 3).alias("element_id"), "vector")
    return meaning.rerank_candidates(pages, asked, block=16).select("query_id", "page_id", "element_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("packed_vectors", """
SELECT vec_id, CAST(list_sum(list_transform(v, lambda x: greatest(-128, least(127, floor(x / CASE WHEN n = 0 THEN 1 ELSE n END * 127 + 0.5))))) AS BIGINT) AS total, CAST(list_min(list_transform(v, lambda x: floor(x / CASE WHEN n = 0 THEN 1 ELSE n END * 127 + 0.5))) AS BIGINT) AS least
FROM (SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS v, sqrt(list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)""")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = retrieval.pack_vector(F.col("embedding"), 32)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(packed, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min(packed).cast("long").alias("least"))


@query("vector_texts", """
SELECT vec_id, true AS same FROM embeddings""")
def vector_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed vectors come back from their base64 texts."""
    packed = retrieval.pack_vector(F.col("embedding"), 32)
    return table(spark, sf_dir, "embeddings").select("vec_id", (retrieval.text_vector(retrieval.vector_text(packed)) == packed).alias("same"))


@query("embed_pieces", """
WITH p AS (SELECT doc_id, length(text) AS n, text FROM documents)
SELECT doc_id, CAST(i AS INT) AS piece_no, length(text[i * 7200 + 1:(i + 1) * 7200]) AS n_chars, md5(text[i * 7200 + 1:(i + 1) * 7200]) AS digest FROM p, unnest(range(0, greatest(n - 1, 0) // 7200 + 1)) t(i)""")
def embed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 1,800 tokens of every text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit("e1").alias("element_id"), F.lit(None).cast("string").alias("heading"), "text")
    pieces = retrieval.embed_pieces(docs)
    return pieces.select(F.col("page_id").alias("doc_id"), "piece_no", F.length("piece").cast("long").alias("n_chars"), F.md5("piece").alias("digest"))


@query("outline_budget", """
WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS size FROM conversations),
w AS (SELECT conv_id, turn, CASE WHEN size <= 600 THEN true ELSE false END AS kept, 600 - CASE WHEN size <= 600 THEN size ELSE 0 END AS budget FROM r WHERE turn = 0
  UNION ALL SELECT r.conv_id, r.turn, size <= budget, budget - CASE WHEN size <= budget THEN size ELSE 0 END FROM w JOIN r ON r.conv_id = w.conv_id AND r.turn = w.turn + 1)
SELECT conv_id, turn, length(text) AS size FROM conversations JOIN w USING (conv_id, turn) WHERE kept""")
def outline_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that still fit a budget of 600 characters; larger ones are passed over."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return retrieval.greedy_fit(rows, ["conv_id"], "turn", "size", 600)


@query("prefix_budget", """
SELECT conv_id, turn, length(text) AS size FROM conversations QUALIFY sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) <= 900""")
def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return retrieval.prefix_fit(rows, ["conv_id"], "turn", "size", 900)


@query("search_results", """
SELECT page_id, CAST(1 AS INT) AS place, 'About ' || page_id AS title, url, 'page ' || page_id AS display_url, 'first & only' AS snippet FROM pages
UNION ALL SELECT page_id, 2, 'Second', '/plain?x=1', '', '' FROM pages WHERE page_id % 2 = 0""")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lists of saved search pages, here written around the pages' URLs: redirects are decoded, results without a title left out."""
    link = F.concat(F.lit("//example.net/l/?uddg="), F.url_encode("url"), F.lit("&amp;rut=x"))
    one = F.concat(F.lit('<div class="result web"><h2><a class="result__a" href="'), link, F.lit('">About <b>'), "page_id", F.lit('</b></a></h2><span class="result__url"> page\n'), "page_id", F.lit('</span><p class="result__snippet">first &amp; only</p></div>'))
    two = F.when(F.col("page_id") % 2 == 0, '<div class="result"><a class="result__a" href="/plain?x=1">Second</a></div>').otherwise('<div class="result"><a class="result__a" href="/y"> </a></div><div class="result">none</div>')
    return html.search_page_results(table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<body>"), one, two).alias("html")))

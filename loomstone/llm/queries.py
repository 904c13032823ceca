"""Registered queries of the training-data operators: thin contracts over the operators of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import chat, collocations, fmindex, langid, lattice, linefreq, mixing, secrets, simhash, substring, tokens, toxicity, vectors
from loomstone.llm.scratch import cut


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, count and checksum of every document's token ids, read back from the range-coded files."""
    import public_tokenizers

    return tokens.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those that repeat an earlier passage, and a digest of the rest."""
    return substring.remove_repeats(_read(spark, sf_dir, "documents"), with_text=False)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op4_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector."""
    return vectors.near_vectors(_read(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from the labels that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")), ["doc_id"])
    forms = [f"{f}_weight" for f in toxicity.FORMS]
    return found.select("doc_id", langid.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *forms)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with its source's size and target."""
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from the part that is not held out."""
    docs = _read(spark, sf_dir, "documents")
    found = langid.detect(docs, langid.fit(docs), ["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets of every document and the spans that inferred formats add."""
    docs = _read(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.fit(docs), ["doc_id"])
    base = F.sha2(secrets.span_text("base").cast("binary"), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), secrets.span_text("spans").alias("spans"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the written output."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    out = cut(chat.format_chats(rows.union(probe)), "chat")
    turns = chat.parse_chats(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text("segments")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        digest(told).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        digest(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: DuckDB: escaped length by replacing in the template's order; marks by role.
_ESCAPED = "replace(coalesce(text, ''), '\\', '\\\\')"
for _c in chat.LLAMA.controls:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
_MARKS = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in chat.LLAMA.marks.items()) + " END"

OP9_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED}) + {_MARKS}) AS BIGINT) AS formatted_chars,
  regexp_matches(string_agg(role, ' ' ORDER BY turn, role, text), '^(system )?user( assistant user)*( assistant)?$') AS valid
FROM c GROUP BY conv_id
"""


def op10_fmindex_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark windows, and the items that they come from."""
    found = fmindex.contaminated_spans(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), ["doc_id"])
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    hit = fmindex.n_hit()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        fmindex.is_contaminated(hit, F.col("n_words")).alias("contaminated"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every order of five filters, by language."""
    return lattice.audit(lattice.corpus_masks(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "labels"))


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of every document's words and lines, and whether it stays without the lines that its source repeats."""
    return linefreq.line_quality(_read(spark, sf_dir, "documents"), with_text=False)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to five words of every language."""
    return collocations.collocations(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_substring_dedup": op2_substring_dedup,
    "op4_vector_near_dedup": op4_vector_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_source_mixing": op6_source_mixing,
    "op7_language_id": op7_language_id,
    "op8_secret_scan": op8_secret_scan,
    "op9_chat_format": op9_chat_format,
    "op10_fmindex_decontamination": op10_fmindex_decontamination,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_line_quality": op12_line_quality,
    "op13_collocations": op13_collocations,
}

#: DuckDB: every window of 20 words with the least place where it starts; words of windows that start earlier go.
OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, w, min(r) AS id FROM d GROUP BY doc_id, w),
g AS (SELECT t.*, row_number() OVER (ORDER BY doc_id NULLS FIRST, id) AS k FROM t),
windows AS (SELECT k, doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS x FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM g WHERE len(w) >= 20)),
first_of AS (SELECT x, min(struct_pack(k := k, p := p)) AS f FROM windows GROUP BY x),
covered AS (SELECT DISTINCT k, unnest(range(p, p + 20)) AS i FROM windows JOIN first_of USING (x) WHERE f <> struct_pack(k := k, p := p)),
words AS (SELECT k, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM g),
kept AS (SELECT k, count(c.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (c.i IS NULL), '') AS text FROM words LEFT JOIN covered c USING (k, i) GROUP BY k)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.w = g.w LEFT JOIN kept ON kept.k = g.k
"""

#: DuckDB: all pairs in double precision; classes by spreading the least vec_id along links.
OP4_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM e
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
classes AS (SELECT x, min(y) AS least FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least AS component_id, e.vec_id = least AS kept
FROM e JOIN classes ON classes.x = e.vec_id LEFT JOIN degree ON degree.x = e.vec_id
"""

#: DuckDB: occurrences of every window of the benchmark by the windows of the same length that documents have.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
phrases AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM phrases),
windows AS (SELECT k, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS x FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN lengths ON len(w) >= n)),
found AS (SELECT k, p, windows.n, item_id FROM windows JOIN phrases ON phrases.n = windows.n AND phrases.x = windows.x),
hits AS (SELECT k, count(DISTINCT i) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS i FROM found) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (k) LEFT JOIN items USING (k)
"""

#: DuckDB: every order by recursion; the documents of a mask that each step meets.
OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failing
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
),
m AS (SELECT part, failing, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failing),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT '' AS o UNION ALL SELECT o || c FROM orders, letters WHERE NOT contains(o, c)),
steps AS (SELECT o AS filter_order, s AS step, substr(o, 1, s - 1) AS done, substr(o, s, 1) AS c FROM orders, range(1, 6) t(s) WHERE len(o) = 5),
met AS (
  SELECT part, filter_order, step, c, n, good, toxic, failing, contains(failing, c) AS fails,
    len(list_intersect(string_split(failing, ''), string_split(done, ''))) > 0 AND done <> '' AND failing <> '' AS gone FROM steps, m
),
told AS (
  SELECT part, filter_order, step, c, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (failing = c), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM told
"""

#: DuckDB: runs of words and lines as strings, counted by grouping.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
),
runs AS (SELECT r, p, array_to_string(list_slice(w, p, p + 7), ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, x) AS n FROM runs) WHERE n > 1),
repeats AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(p, p + 8)) AS i FROM twice) GROUP BY r),
lined AS (
  SELECT r, source, t, regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') AS x FROM (SELECT r, source, t, unnest(lines) AS line FROM d)
),
hosts AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
counted AS (SELECT source, x, count(DISTINCT t) AS n FROM lined GROUP BY source, x),
common AS (SELECT counted.source, x FROM counted JOIN hosts ON counted.source IS NOT DISTINCT FROM hosts.source WHERE n > 20 AND 100 * n > texts),
lost AS (SELECT r, sum(len(string_split(lined.x, ' '))) AS n FROM lined JOIN common ON lined.source IS NOT DISTINCT FROM common.source AND lined.x = common.x GROUP BY r),
told AS (
  SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_common_words
  FROM d LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
  AND NOT (n_common_words > 0 AND (n_words - n_common_words < 20 OR 100 * (n_words - n_common_words) < 50 * n_words)) AS kept
FROM told
"""

#: DuckDB: all runs of up to five words counted; cuts and containment by joins of the frequent ones.
OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
pieces AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(p) AS x FROM d)),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
runs AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM runs GROUP BY lang, k, phrase HAVING count(*) >= 100),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(list_slice(w, 1, c), ' ') AS x, array_to_string(list_slice(w, c + 1, k), ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1)),
cut_scores AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, c, l.a AS l, r.a AS r, CAST(t.n AS BIGINT) AS n,
    CAST(CAST(1000 AS HUGEINT) * cuts.a * t.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y JOIN totals t ON t.lang = cuts.lang
),
best AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, array_to_string(list_slice(w, i, i + j - 1), ' ') AS phrase, max(a) AS a FROM (SELECT lang, w, a, j, unnest(range(1, k - j + 2)) AS i FROM f, range(2, 5) t(j) WHERE j < k) GROUP BY ALL)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, best.phrase) AS rank, best.phrase, best.a, l, r, n, score
FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase WHERE inside.a IS NULL OR 100 * inside.a < 100 * best.a
QUALIFY row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, best.phrase) <= 2000
"""

ORACLES: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op4_vector_near_dedup": OP4_SQL,
    "op9_chat_format": OP9_SQL,
    "op10_fmindex_decontamination": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_line_quality": OP12_SQL,
    "op13_collocations": OP13_SQL,
}

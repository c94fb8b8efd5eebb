"""Queries of the engine over the given tables, and DuckDB SQL for those that SQL can express.

Spans, logits and edits that a model would make are derived from the tables by rules that both sides state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import edits, labels, text, vectors
from .operators import alignment, evaluate, markup, spans, spelling, synth, tagging
from .plans import analyze
from .sources import readers
from .streaming import editing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


# --- SQL in common -------------------------------------------------------------------------------------------------
_RE = text.word_pattern().replace("'", "''")
_SP = f"[{text.SPACES}]"
_WORDS = f"regexp_extract_all(text, '{_RE}')"
_NUM = r"^\d+([.,]\d+)*$"
_SKIP = rf"(regexp_matches(x, '{_NUM}') OR regexp_matches(x, '^https?://') OR contains(x, '@') OR length(x) < 2 OR x = upper(x))"
_CHECKED = rf"list_filter(w, lambda x, i: NOT {_SKIP} AND NOT (length(x) <= 5 AND i > 1 AND regexp_matches(w[i - 1], '{_NUM}')))"
_LEX = f"lex AS (SELECT lower(x) AS word, count(*) AS freq FROM (SELECT unnest({_WORDS}) AS x FROM documents) GROUP BY 1), known AS (SELECT * FROM lex WHERE freq >= 5)"


def _tokens_sql(source: str, key: str) -> str:
    return f"""t0 AS (SELECT {key} AS doc_id, text, {_WORDS} AS w, regexp_split_to_array(text, '{_RE}') AS g FROM {source}),
t1 AS (SELECT doc_id, text, unnest(w) AS word, unnest(g[1:len(w)]) AS gap, unnest(range(len(w))) AS pos, g[len(g)] AS tail FROM t0 WHERE len(w) > 0),
tok AS (SELECT doc_id, text, CAST(pos AS INTEGER) AS pos, word, gap, tail,
    CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY pos) - length(word) AS INTEGER) AS s,
    CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS e FROM t1)"""




def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SP}+', ''), '{_SP}+$', '')"


_ACC = "translate({}, 'áéíóúüñçàèìòùâêîôû', 'ABCDEFGHIJKLMNOPQRS')"
_PAIRS = f"""{_LEX},
typed AS (SELECT DISTINCT lower(x) AS typed FROM (SELECT unnest({_CHECKED}) AS x FROM (SELECT {_WORDS} AS w FROM documents)) WHERE lower(x) NOT IN (SELECT word FROM known)),
a AS (SELECT typed, unnest(list_distinct(list_concat([typed], list_transform(range(1, length(typed) + 1), lambda i: left(typed, i - 1) || substr(typed, i + 1))))) AS k FROM typed),
b AS (SELECT word AS cand, freq, unnest(list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1))))) AS k FROM known),
met AS (SELECT DISTINCT typed, cand, freq, {_ACC.format('typed')} AS ta, {_ACC.format('cand')} AS ca FROM a JOIN b USING (k) WHERE typed <> cand AND abs(length(typed) - length(cand)) <= 1),
pairs AS (SELECT typed, cand, freq, 1 AS ed FROM met WHERE damerau_levenshtein(ta, ca) = 1 AND (levenshtein(ta, ca) = 2
    OR length(cand) < length(typed) OR (length(cand) - length(replace(cand, '-', '')) <= length(typed) - length(replace(typed, '-', ''))
    AND length(cand) - length(replace(cand, '''', '')) <= length(typed) - length(replace(typed, '''', '')))))"""
_RANKED = f"{_PAIRS}, scored AS (SELECT typed, cand, ed, freq, 0.3::DOUBLE * ln(freq + 1) + 0.5::DOUBLE * (1.0::DOUBLE / (1 + ed)) AS raw FROM pairs), ranked AS (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY raw DESC, cand) AS rank FROM scored)"


# --- Lexicon, detection, candidates ---------------------------------------------------------------------------------
@query(f"SELECT lower(x) AS word, count(*) AS freq FROM (SELECT unnest({_WORDS}) AS x FROM documents) GROUP BY 1")
def lexicon_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.build_lexicon(_docs(spark, sf_dir))


@query(f"WITH {_tokens_sql('documents', 'doc_id')} SELECT doc_id, pos, word, s AS \"start\", e AS \"end\" FROM tok")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.tokens(_docs(spark, sf_dir))


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len({_CHECKED}) AS BIGINT) AS n_checked FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.words("text").alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(text.checkable("w")).cast("long").alias("n_checked"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.known_words(spelling.build_lexicon(_docs(spark, sf_dir)))


@query(f"WITH {_LEX} SELECT doc_id, x AS word, count(*) AS n FROM (SELECT doc_id, unnest({_CHECKED}) AS x FROM (SELECT doc_id, {_WORDS} AS w FROM documents)) WHERE lower(x) NOT IN (SELECT word FROM known) GROUP BY 1, 2")
def oov_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.unknown_words(_docs(spark, sf_dir), _known(spark, sf_dir))


_A = f"string_split('{edits.ALPHABET}', '')"


@query(f"""
WITH d AS (SELECT DISTINCT lower(x) AS word FROM (SELECT unnest({_WORDS}) AS x FROM benchmark)),
v AS (SELECT word, list_distinct(list_concat(list_concat(list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1)),
    list_transform(range(1, length(word)), lambda i: left(word, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2))),
    list_concat(flatten(list_transform(range(1, length(word) + 1), lambda i: list_transform({_A}, lambda c: left(word, i - 1) || c || substr(word, i + 1)))),
    flatten(list_transform(range(1, length(word) + 2), lambda i: list_transform({_A}, lambda c: left(word, i - 1) || c || substr(word, i))))))) AS v FROM d)
SELECT word, CAST(len(list_filter(v, lambda x: x <> word)) AS BIGINT) AS n_variants, md5(array_to_string(list_sort(list_filter(v, lambda x: x <> word)), ',')) AS digest FROM v""")
def edits1_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _items(spark, sf_dir).select(F.explode(text.words("text")).alias("w")).select(F.lower("w").alias("word")).distinct()
    return words.select("word", edits.edits1("word").alias("v")).select("word", F.size("v").cast("long").alias("n_variants"), F.md5(F.array_join(F.sort_array("v"), ",")).alias("digest"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known(spark, sf_dir)
    return spelling.candidate_pairs(spelling.unknown_vocabulary(_docs(spark, sf_dir), known), known)


@query(f"WITH {_PAIRS} SELECT typed, cand, freq, ed FROM pairs")
def candidate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"WITH {_RANKED} SELECT typed, cand, ed, freq, round(raw, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked")
def candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.rank_candidates(_pairs(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {_RANKED} SELECT typed, cand, ed, freq, round(raw, 6) AS score FROM ranked WHERE rank = 1")
def candidate_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.best_candidates(_pairs(spark, sf_dir)).select("typed", "cand", "ed", "freq", F.round("score", 6).alias("score"))


@query(f"WITH {_RANKED} SELECT typed, string_agg(cand, ',' ORDER BY rank) AS cands FROM ranked WHERE rank <= 5 GROUP BY typed")
def candidate_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = spelling.rank_candidates(_pairs(spark, sf_dir), top=5)
    return top.groupBy("typed").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "cand"))), lambda x: x["cand"]), ",").alias("cands"))


@query(f"""WITH {_RANKED}, n AS (SELECT *, count(*) OVER (PARTITION BY typed) AS n, length(cand) / 40.0::DOUBLE AS s FROM ranked),
c AS (SELECT *, CASE WHEN n >= 2 THEN raw + 18.0::DOUBLE * s ELSE -rank END AS total FROM n WHERE rank <= 5)
SELECT typed, cand, round(raw, 6) AS score, CASE WHEN n >= 2 THEN round(s, 6) END AS sim FROM (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY total DESC, rank) AS r FROM c) WHERE r = 1""")
def rerank_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = spelling.rank_candidates(_pairs(spark, sf_dir))
    similarity = ranked.select("typed", "cand", (F.length("cand") / F.lit(40.0)).alias("sim"))
    return spelling.rerank(ranked, similarity, ["typed"]).select("typed", "cand", F.round("score", 6).alias("score"), F.round("sim", 6).alias("sim"))


@query(f"""WITH d AS (SELECT DISTINCT x AS word, regexp_extract_all(x, '\\p{{L}}') AS l FROM (SELECT unnest({_WORDS}) AS x FROM documents)),
u AS (SELECT word, l, len(list_filter(l, lambda c: lower(c) <> c AND upper(c) = c)) AS n FROM d)
SELECT word, CASE WHEN len(l) = 0 THEN 'oñati' WHEN n = len(l) AND n > 1 THEN 'OÑATI' WHEN n = 1 AND lower(l[1]) <> l[1] AND upper(l[1]) = l[1] THEN 'Oñati' ELSE 'oñati' END AS cased FROM u""")
def match_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.word_rows(_docs(spark, sf_dir)).select("word").distinct().withColumn("cased", text.match_case("word", F.lit("oñati")))


# --- Scalars --------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '{_SP}+')) END::BIGINT AS n_words, length(text)::BIGINT AS n_chars FROM (SELECT doc_id, text, {_trim('text')} AS t FROM documents)")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.document_stats(_docs(spark, sf_dir))


@query(f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS li, len(ls) AS n FROM l),
s AS (SELECT doc_id, li, n, list_filter(list_transform(string_split(regexp_replace(line, '([.?!]){_SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_trim('x')}), lambda x: x <> '') AS ss, {_trim('line')} = '' AS blank FROM u),
v AS (SELECT doc_id, li, n, unnest(ss) AS t, unnest(range(len(ss))) AS si FROM s WHERE NOT blank),
k AS (SELECT doc_id, li, si, n, t, regexp_split_to_array(t, '{_SP}+') AS w FROM v),
c AS (SELECT doc_id, li, si, n, w, unnest(CASE WHEN len(w) > 25 THEN range(0, len(w), 20) ELSE [0] END) AS i FROM k),
o AS (SELECT doc_id, li, si, i, CASE WHEN len(w) > 25 THEN array_to_string(w[i + 1:i + 20], ' ') ELSE array_to_string(w, chr(2)) END AS text, w,
    CASE WHEN len(w) > 25 AND i + 20 < len(w) THEN ' ' WHEN li < n - 1 THEN chr(10) ELSE '' END AS sep FROM c),
p AS (SELECT o.doc_id, o.li, o.si, o.i, CASE WHEN len(o.w) > 25 THEN o.text ELSE k.t END AS text, o.sep FROM o JOIN k USING (doc_id, li, si)
    UNION ALL SELECT doc_id, li, 0, 0, '', chr(10) FROM s WHERE blank)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY li, si, i) - 1 AS INTEGER) AS pos, text, sep FROM p""")
def segment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(text.segments("text")).alias("pos", "s")).select("doc_id", "pos", "s.*")


_PUNCT = text.PUNCTUATION.replace("'", "''")


_PADDED = f"regexp_replace(regexp_replace(text, '({_PUNCT})', ' \\1 ', 'g'), '{_SP}+', ' ', 'g')"


@query(f"SELECT doc_id, {_trim(_PADDED)} AS tokenized FROM documents")
def punct_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.tokenize_punctuation("text").alias("tokenized"))


@query(f"SELECT doc_id, regexp_replace(text, '{_SP}+({_PUNCT})', '\\1', 'g') AS detokenized FROM documents")
def punct_detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.detokenize_punctuation("text").alias("detokenized"))


@query(f"""WITH {_tokens_sql('benchmark', 'item_id')}, c AS (SELECT doc_id, pos, list_last(string_split(left(text, s), chr(10))) AS p FROM tok)
SELECT doc_id, pos, regexp_replace(CASE WHEN length(p) > 28 THEN '…' ELSE '' END || right(p, 28), '{_SP}+$', '') AS context FROM c""")
def context_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return spelling.tokens(items).join(items, "doc_id").select("doc_id", "pos", text.context_before("text", "start").alias("context"))


@query("SELECT doc_id, left(regexp_replace(regexp_replace(regexp_extract('# ' || text, '(?m)^#\\s+(.+)$', 1), '[*_`#]', '', 'g'), '^\\s+|\\s+$', '', 'g'), 50) AS title FROM documents WHERE regexp_extract('# ' || text, '(?m)^#\\s+(.+)$', 1) <> ''")
def title_from_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.title_from_h1(F.concat(F.lit("# "), F.col("text"))).alias("title")).where("title is not null")


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS digest FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.escape_html("html")).alias("digest"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<!--.*?-->|</?[A-Za-z!][^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) AS digest FROM pages")
def html_strip_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_tags("html")).alias("digest"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.with_html_text(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.length("plain").cast("long").alias("n_chars"), F.md5("plain").alias("digest"))


@query()
def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.with_plain_text(_docs(spark, sf_dir), "text").select("doc_id", F.md5("plain").alias("digest"), F.size("mapping").cast("long").alias("n_chars"), F.size("headings").cast("long").alias("n_headings"))


# --- Spans ----------------------------------------------------------------------------------------------------------
def _rule_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span for each token of `benchmark`, some of them over the next words."""
    category = F.element_at(F.array(F.lit("grammar"), F.lit("spelling"), F.lit("cappunct")), (F.col("pos") % 3 + 1).cast("int"))
    return spelling.tokens(_items(spark, sf_dir)).select("doc_id", F.col("start").alias("from"), (F.col("end") + (F.col("pos") % 5) * 4).cast("int").alias("to"), F.col("word").alias("original"), F.upper("word").alias("suggestion"),
        category.alias("category"), F.lit("").alias("title"), F.when(F.col("pos") % 11 == 0, "accepted").otherwise("pending").alias("status"), F.when(F.col("pos") % 7 != 0, (F.col("pos") % 21) / F.lit(20.0)).alias("confidence"), "pos")


_SPANS = f"""{_tokens_sql('benchmark', 'item_id')}, sp AS (SELECT doc_id, s AS f, CAST(e + (pos % 5) * 4 AS INTEGER) AS t, word, pos, (['grammar', 'spelling', 'cappunct'])[pos % 3 + 1] AS category,
    CASE WHEN pos % 11 = 0 THEN 'accepted' ELSE 'pending' END AS status, CASE WHEN pos % 7 <> 0 THEN (pos % 21) / 20.0::DOUBLE END AS confidence FROM tok)"""


@query(f"WITH {_SPANS} SELECT doc_id, f AS \"from\", t AS \"to\", category, confidence FROM sp WHERE confidence IS NULL OR confidence >= CASE category WHEN 'grammar' THEN 0.05 WHEN 'spelling' THEN 0.5 ELSE 1.0 END")
def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.filter_by_confidence(_rule_spans(spark, sf_dir)).select("doc_id", "from", "to", "category", "confidence")


@query(f"WITH {_SPANS} SELECT coalesce(category, 'all') AS category, count(*) AS n FROM sp WHERE status = 'pending' GROUP BY ROLLUP (category)")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.category_counts(_rule_spans(spark, sf_dir))


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _rule_spans(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "from", "to", "category"))).alias("s"))
    return listed.select("doc_id", spans.span_order("s").alias("s"))


_ORDER = "row_number() OVER (PARTITION BY doc_id ORDER BY f, t - f DESC, CASE category WHEN 'grammar' THEN 0 WHEN 'spelling' THEN 1 ELSE 2 END, pos)"


@query(f"WITH {_SPANS} SELECT doc_id, CAST({_ORDER} - 1 AS INTEGER) AS rank, f AS \"from\", t AS \"to\", category FROM sp")
def span_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir).select("doc_id", F.posexplode("s").alias("rank", "x")).select("doc_id", "rank", "x.from", "x.to", "x.category")


@query(f"""WITH RECURSIVE {_SPANS}, o AS (SELECT doc_id, f, t, category, {_ORDER} AS r FROM sp),
walk AS (SELECT doc_id, r, f, t, category, true AS keep, t AS last FROM o WHERE r = 1
    UNION ALL SELECT o.doc_id, o.r, o.f, o.t, o.category, o.f >= w.last, CASE WHEN o.f >= w.last THEN o.t ELSE w.last END FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.r = w.r + 1)
SELECT doc_id, f AS "from", t AS "to", category FROM walk WHERE keep""")
def overlap_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir).select("doc_id", F.inline(spans.without_overlaps("s"))).select("doc_id", "from", "to", "category")


@query(f"""WITH {_tokens_sql('benchmark', 'item_id')}, m AS (SELECT doc_id, pos, lower(word) AS w, upper(left(word, 1)) <> lower(left(word, 1)) AS letter FROM tok)
SELECT doc_id, string_agg(CASE WHEN letter THEN upper(left(w, 1)) || substr(w, 2) ELSE w END || 'k', ' ' ORDER BY pos) FILTER (pos % 2 = 0) AS merged,
    CAST(count(*) FILTER (pos % 2 = 1 OR NOT letter) AS INTEGER) AS caps_left FROM m GROUP BY doc_id""")
def capmerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("word")
    rows = spelling.tokens(_items(spark, sf_dir)).select("doc_id", "pos", F.struct(F.col("start").alias("from"), F.col("end").alias("to"), low.alias("original"), F.concat(low, F.lit("k")).alias("suggestion")).alias("t"),
        F.struct(F.col("start").alias("from"), F.col("end").alias("to"), low.alias("original"), text.capitalized(low).alias("suggestion")).alias("c"))
    listed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("pos") % 2 == 0, F.col("t")))).alias("t"), F.sort_array(F.collect_list("c")).alias("c"))
    done = listed.select("doc_id", spans.merge_cap_punct(F.col("t"), F.col("c")).alias("m"))
    return done.select("doc_id", F.array_join(F.transform("m.targets", lambda t: t["suggestion"]), " ").alias("merged"), F.size("m.caps").alias("caps_left"))


def _listed(spark: SparkSession, sf_dir: str, wanted: Column, *fields: Column) -> DataFrame:
    """doc_id, text, s: the spans of wanted tokens of `benchmark`, in order."""
    items = _items(spark, sf_dir)
    rows = spelling.tokens(items).where(wanted).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").alias("from"), F.col("end").alias("to"), *fields))).alias("s"))
    return items.join(rows, "doc_id")


@query(f"WITH {_tokens_sql('benchmark', 'item_id')} SELECT doc_id, string_agg(gap || CASE WHEN pos % 3 = 0 THEN upper(word) || '!' ELSE word END, '' ORDER BY pos) || any_value(tail) AS text FROM tok GROUP BY doc_id")
def splice_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listed(spark, sf_dir, F.col("pos") % 3 == 0, F.concat(F.upper("word"), F.lit("!")).alias("suggestion"))
    return rows.select("doc_id", spans.apply_edits("text", "s").alias("text"))


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""WITH {_tokens_sql('benchmark', 'item_id')} SELECT doc_id, string_agg({_esc('gap')} || CASE
    WHEN pos % 4 = 0 THEN '<span class="spell-error" title="Zuzenketak / Suggestions: a, ' || replace(word, '"', '&quot;') || '" data-suggestions="a,' || {_esc('word')} || '" data-word="' || word || '">' || {_esc('word')} || '</span>'
    WHEN pos % 4 = 2 THEN '<span class="spell-corrected" title="' || word || ' → ' || upper(word) || '">' || {_esc('upper(word)')} || '</span>' ELSE {_esc('word')} END, '' ORDER BY pos) || {_esc('any_value(tail)')} AS html FROM tok GROUP BY doc_id""")
def annotate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listed(spark, sf_dir, F.col("pos") % 2 == 0, F.col("word").alias("original"), F.upper("word").alias("suggestion"), F.when(F.col("pos") % 4 == 0, "error").otherwise("correction").alias("kind"), F.array(F.lit("a"), F.col("word")).alias("suggestions"))
    return rows.select("doc_id", spans.annotate("text", "s").alias("html"))


@query(f"""WITH {_tokens_sql('benchmark', 'item_id')} SELECT c.doc_id, c.s AS "from", c.e AS "to", CASE WHEN c.pos % 3 = 0 THEN (c.pos % 10) / 10.0::DOUBLE END AS confidence FROM tok c WHERE c.pos % 2 = 0""")
def confidence_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = spelling.tokens(_items(spark, sf_dir))
    changes = tokens.where("pos % 2 = 0").select("doc_id", F.col("start").alias("from"), F.col("end").alias("to"))
    found = tokens.where("pos % 3 = 0").select("doc_id", "start", "end", ((F.col("pos") % 10) / F.lit(10.0)).alias("p_incorrect"), "pos")
    return spans.attach_confidence(changes, found).select("doc_id", "from", "to", "confidence")


# --- Vectors, logits, labels ------------------------------------------------------------------------------------------
@query("""WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings),
m AS (SELECT label, d, avg(x) AS m FROM u GROUP BY 1, 2),
c AS (SELECT u.vec_id, u.label, sum(x * m) AS p, sqrt(sum(x * x)) AS nx, sqrt(sum(m * m)) AS nm FROM u JOIN m USING (label, d) GROUP BY 1, 2),
r AS (SELECT vec_id, label, p / ((nx + 1e-8) * (nm + 1e-8)) AS s FROM c)
SELECT label, vec_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS n FROM r) WHERE n <= 5""")
def embedding_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    means = rows.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    means = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("mean"))
    scored = rows.join(means, "label").select("label", "vec_id", vectors.cosine("embedding", "mean").alias("s"))
    n = F.row_number().over(Window.partitionBy("label").orderBy(F.round("s", 9).desc(), "vec_id"))
    return scored.withColumn("n", n).where("n <= 5").select("label", "vec_id", F.round("s", 6).alias("score"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: exp(10.0::DOUBLE * x - 10.0::DOUBLE * list_max(embedding[1:8]))) AS g FROM embeddings),
p AS (SELECT vec_id, list_transform(g, lambda x: x / list_sum(g)) AS p FROM e)
SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS label_id, round(list_max(p), 6) AS p_label FROM p""")
def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 10)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.softmax(logits).alias("p"))
    return rows.select("vec_id", vectors.argmax("p").alias("label_id"), F.round(F.array_max("p"), 6).alias("p_label"))


@query("""WITH e AS (SELECT vec_id, vec_id // 8 AS doc_id, list_transform(embedding[1:4], lambda x: exp(20.0::DOUBLE * x)) AS g, exp(20.0::DOUBLE * embedding[5]) AS a, exp(20.0::DOUBLE * embedding[6]) AS b FROM embeddings),
p AS (SELECT vec_id, doc_id, list_transform(g, lambda x: x / list_sum(g)) AS p, b / (a + b) AS q FROM e),
m AS (SELECT *, max(q) OVER (PARTITION BY doc_id) AS most FROM p)
SELECT doc_id, vec_id, CASE WHEN most < 0.5 OR list_max(p) < 0.5 THEN 0 ELSE CAST(list_position(p, list_max(p)) - 1 AS INTEGER) END AS label_id, round(most, 6) AS max_error FROM m""")
def detect_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    twenty = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double") * 20)
    logits = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 8").alias("doc_id"), F.col("vec_id").alias("tok"), F.col("vec_id").alias("word_id"), twenty(1, 4).alias("labels"), twenty(5, 2).alias("detect"))
    return tagging.gated(tagging.probabilities(tagging.first_subwords(logits))).select("doc_id", "vec_id", "label_id", F.round("max_error", 6).alias("max_error"))


@query(f"""WITH w AS (SELECT item_id AS doc_id, regexp_extract_all(text, '[^{text.SPACES}]+') AS w FROM benchmark),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w)
SELECT doc_id, coalesce(string_agg(CASE i % 5 WHEN 1 THEN NULL WHEN 2 THEN 'eta' WHEN 3 THEN x || ' ere' ELSE x END, ' ' ORDER BY i), '') AS text FROM u GROUP BY doc_id""")
def edit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select("doc_id", text.plain_tokens("text").alias("w"))
    labels = F.transform("w", lambda x, i: F.element_at(F.array(*(F.lit(v) for v in ("$KEEP", "$DELETE", "$REPLACE_eta", "$APPEND_ere", "$KEEP"))), (i % 5 + 1).cast("int")))
    return rows.select("doc_id", tagging.labelled_words("w", labels).alias("text"))


# --- Typos and metrics ----------------------------------------------------------------------------------------------
@query()
def typo_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.generate_typos(table(spark, sf_dir, "benchmark")).select("item_id", "correct", "erroneous", F.inline("edits"))


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = synth.generate_typos(table(spark, sf_dir, "benchmark")).select("item_id", F.inline("edits"))
    return evaluate.gold_ranks(cases, _known(spark, sf_dir))


@query()
def rank_of_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir)


@query()
def spelling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.spelling_metrics(_ranks(spark, sf_dir))


@query()
def recall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall_by_type(_ranks(spark, sf_dir))


@query(f"""WITH {_PAIRS}, c AS (SELECT lower(x) AS typed, count(*) AS n FROM (SELECT unnest({_CHECKED}) AS x FROM (SELECT {_WORDS} AS w FROM documents)) GROUP BY 1),
s AS (SELECT sum(n)::BIGINT AS checked, coalesce(sum(n) FILTER (typed NOT IN (SELECT word FROM known)), 0)::BIGINT AS false_detections, coalesce(sum(n) FILTER (typed IN (SELECT typed FROM pairs)), 0)::BIGINT AS false_corrections FROM c)
SELECT *, printf('%.1f%%', round(false_detections / checked * 100, 1)) AS detection_rate, printf('%.1f%%', round(false_corrections / checked * 100, 1)) AS correction_rate FROM s""")
def false_positive_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.false_positive_metrics(_docs(spark, sf_dir), _known(spark, sf_dir))


@query(r"""WITH p AS (SELECT item_id, regexp_split_to_array(text, '\s+') AS c, regexp_split_to_array(replace(text, 'th', 'ht'), '\s+') AS e FROM benchmark),
u AS (SELECT item_id, unnest(range(len(c))) AS position, unnest(c) AS c, unnest(e) AS e FROM p),
s AS (SELECT item_id, position, regexp_replace(c, '[^A-Za-zÀ-ÿ''\-]', '', 'g') AS correct_word, regexp_replace(e, '[^A-Za-zÀ-ÿ''\-]', '', 'g') AS erroneous_word FROM u WHERE c <> e)
SELECT item_id, CAST(position AS INTEGER) AS position, correct_word, erroneous_word FROM s WHERE correct_word <> '' AND erroneous_word <> '' AND lower(correct_word) <> lower(erroneous_word)""")
def positional_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("correct"), F.replace("text", F.lit("th"), F.lit("ht")).alias("erroneous"))
    return alignment.positional_differences(pairs).select("item_id", "position", "correct_word", "erroneous_word")


@query("""WITH p AS (SELECT (n_chars % 100) / 100.0::DOUBLE AS p, quality AS actual FROM labels JOIN documents USING (doc_id)),
c AS (SELECT t AS threshold, count(*) FILTER (p >= t AND actual = 1) AS tp, count(*) FILTER (p >= t AND actual = 0) AS fp, count(*) FILTER (p < t AND actual = 1) AS fn FROM p, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) AS v(t) GROUP BY t),
r AS (SELECT *, tp / (tp + fp) AS pr, tp / (tp + fn) AS re FROM c)
SELECT threshold, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(1.25::DOUBLE * pr * re / (0.25::DOUBLE * pr + re), 6) AS f_beta, round(2 * pr * re / (pr + re), 6) AS f1 FROM r""")
def fscore_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(((F.col("n_chars") % 100) / F.lit(100.0)).alias("p"), F.col("quality").alias("actual"))
    out = evaluate.detection_scores(rows, [0.25, 0.5, 0.75])
    return out.select("threshold", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f_beta", "f1")))


@query(f"""WITH o AS (SELECT text AS source, lower(text) AS target, CASE WHEN doc_id % 2 = 0 THEN lower(text) WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END AS output FROM documents)
SELECT count(*) AS cases, count(*) FILTER (output = target) AS exact, count(*) FILTER (output <> source) AS changed, count(*) FILTER (output <> source AND output = target) AS changed_right, count(*) FILTER (output <> source AND output <> target) AS changed_wrong FROM o""")
def exact_match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = F.when(F.col("doc_id") % 2 == 0, F.lower("text")).when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text"))
    return evaluate.exact_match(_docs(spark, sf_dir).select(F.col("text").alias("source"), F.lower("text").alias("target"), output.alias("output")))


_SCORES = "s AS (SELECT vec_id // 5 AS case_id, 'c' || vec_id AS cand, vec_id % 5 = 2 AS gold, embedding[1]::DOUBLE AS score, embedding[2]::DOUBLE AS sim FROM embeddings)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("case_id"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("cand"), (F.col("vec_id") % 5 == 2).alias("gold"),
        F.get("embedding", F.lit(0)).cast("double").alias("score"), F.get("embedding", F.lit(1)).cast("double").alias("sim"))


@query(f"""WITH {_SCORES}, r AS (SELECT w AS weight, case_id, arg_max(gold, score + w * sim) AS now, arg_max(gold, score) AS before FROM s, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (2.0::DOUBLE)) AS v(w) GROUP BY 1, 2)
SELECT weight, count(*) AS cases, count(*) FILTER (now) AS "right", count(*) FILTER (now AND NOT before) AS better, count(*) FILTER (NOT now AND before) AS worse, count(*) FILTER (now AND NOT before) - count(*) FILTER (NOT now AND before) AS net FROM r GROUP BY weight""")
def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.weight_sweep(_scores(spark, sf_dir), [0.0, 0.5, 2.0])


@query(f"""WITH {_SCORES}, c AS (SELECT case_id, arg_max(gold, score) AS a, arg_max(gold, sim) AS b, arg_max(gold, score + sim) AS c, arg_max(cand, sim) AS bc, arg_max(cand, score + sim) AS cc, max(abs(sim - (score + sim))) AS most, sum(abs(sim - (score + sim))) AS total, count(*) AS n FROM s GROUP BY 1)
SELECT count(*) AS cases, count(*) FILTER (a) AS first_tier, count(*) FILTER (b) AS ours, count(*) FILTER (c) AS theirs, count(*) FILTER (bc = cc) AS agree, round(max(most), 6) AS max_diff, round(sum(total) / sum(n), 6) AS mean_diff FROM c""")
def rerank_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).withColumn("ours", F.col("sim")).withColumn("theirs", F.col("score") + F.col("sim"))
    return evaluate.rerank_comparison(rows).withColumn("max_diff", F.round("max_diff", 6)).withColumn("mean_diff", F.round("mean_diff", 6))


# --- Alignment ------------------------------------------------------------------------------------------------------
@query()
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.concat(F.lower("text"), F.lit(" end")).alias("corrected"))
    return alignment.change_rows(pairs)


@query()
def cap_constrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _items(spark, sf_dir).select("doc_id", F.posexplode(text.segments("text")).alias("pos", "s")).select("doc_id", "pos", F.lower("s.text").alias("text"), F.col("s.text").alias("rewritten"))
    return alignment.constrain(parts).select("doc_id", "pos", "constrained", "match_rate")


@query()
def analyze_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumnRenamed("text", "content")
    return analyze.analyze(docs, analyze.Engine(_known(spark, sf_dir)))


@query()
def auto_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.auto_correct(_docs(spark, sf_dir), _known(spark, sf_dir)).select("doc_id", F.md5("corrected").alias("digest"), "changes")


# --- Editing as events ------------------------------------------------------------------------------------------------
@query("""WITH g AS (SELECT user_id AS doc_id, ts, event_type, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT doc_id, epoch_us(max(ts) + INTERVAL 1 HOUR) AS saved_us, arg_max(event_type, {'t': ts, 'e': event_type}) AS content, count(*) AS edits FROM s GROUP BY doc_id, k""")
def autosave_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "ts", F.col("event_type").alias("content"))
    return editing.autosaves(events, "1 hour").select("doc_id", F.unix_micros("saved_at").alias("saved_us"), "content", "edits")


@query("""WITH e AS (SELECT user_id AS doc_id, event_id AS seq, (['add', 'accept', 'add', 'dismiss', 'add', 'clear'])[event_id * 7 % 6 + 1] AS action, 's' || (event_id // 6 % 4) AS sugg_id FROM events),
c AS (SELECT doc_id, max(seq) AS last FROM e WHERE action = 'clear' GROUP BY 1),
l AS (SELECT e.* FROM e LEFT JOIN c USING (doc_id) WHERE last IS NULL OR seq > last),
a AS (SELECT doc_id, sugg_id, max(seq) AS added FROM l WHERE action = 'add' GROUP BY 1, 2),
d AS (SELECT a.doc_id, a.sugg_id, arg_min(action, seq) AS action FROM a JOIN l USING (doc_id, sugg_id) WHERE l.action IN ('accept', 'dismiss') AND seq > added GROUP BY 1, 2)
SELECT a.doc_id, a.sugg_id, CASE d.action WHEN 'accept' THEN 'accepted' WHEN 'dismiss' THEN 'dismissed' ELSE 'pending' END AS status FROM a LEFT JOIN d USING (doc_id, sugg_id)""")
def suggestion_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.element_at(F.array(*(F.lit(x) for x in ("add", "accept", "add", "dismiss", "add", "clear"))), (F.col("event_id") * 7 % 6 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("s"), F.expr("cast(event_id div 6 % 4 as string)")).alias("sugg_id"))
    return editing.lifecycle(events)


# --- Scalars and spans over the documents -----------------------------------------------------------------------------
@query(f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, '|')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '({_SP}+|[^{text.SPACES}]+)') AS t FROM documents)")
def spaced_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", text.spaced_tokens("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|")).alias("digest"))


_MODEL_OUT = "regexp_replace(regexp_replace('<s> ' || replace(text, ' the ', '  <unk> ') || '</s><pad>', '</?s>|<pad>|<unk>', '', 'g')"


@query(f"SELECT doc_id, md5({_trim(_MODEL_OUT + f', {chr(39)}{_SP}{{2,}}{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}) AS digest FROM documents")
def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.concat(F.lit("<s> "), F.replace("text", F.lit(" the "), F.lit("  <unk> ")), F.lit("</s><pad>"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.clean_model_output(out)).alias("digest"))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.word_rows(_docs(spark, sf_dir)).select("word").distinct()


_VOCABULARY = f"(SELECT DISTINCT x AS word FROM (SELECT unnest({_WORDS}) AS x FROM documents))"


@query(f"SELECT word, regexp_replace(lower(word), '[^a-zà-ÿñü]', '', 'g') AS key FROM {_VOCABULARY}")
def alignment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir).select("word", text.alignment_key("word").alias("key"))


@query(f"SELECT word, strip_accents(word) AS plain, strip_accents(word) <> word AS accented, CASE WHEN length(word) > 8 THEN left(word, 5) || '...' ELSE word END AS short FROM {_VOCABULARY}")
def accents_and_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir).select("word", text.strip_accents("word").alias("plain"), text.has_accent("word").alias("accented"), text.shortened("word", 8).alias("short"))


_LETTERS_ONLY = "lower(regexp_replace({}, '[^\\p{{L}}]', '', 'g'))"
_CHANGED = f"(SELECT word, unnest([upper(word), word || ',', word || 'x', word || ' ' || word, left(word, 1) || ' y']) AS new FROM {_VOCABULARY})"


@query(f"""SELECT word, new, word <> new AND {_LETTERS_ONLY.format('word')} = {_LETTERS_ONLY.format('new')} AND length({_LETTERS_ONLY.format('new')}) > 0 AS case_punct,
    CASE WHEN len(regexp_split_to_array(new, '{_SP}+')) > 1 THEN 'Hitza gehitu' WHEN lower(new) = lower(word) THEN 'Maiuskula' ELSE 'Gramatika' END AS grammar,
    CASE WHEN lower(new) = lower(word) THEN 'Maiuskula' ELSE 'Puntuazioa' END AS cappunct FROM {_CHANGED}""")
def change_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.explode(F.array(F.upper("word"), F.concat("word", F.lit(",")), F.concat("word", F.lit("x")), F.concat("word", F.lit(" "), "word"), F.concat(F.left("word", F.lit(1)), F.lit(" y"))))
    rows = _vocabulary(spark, sf_dir).select("word", new.alias("new"))
    return rows.select("word", "new", text.is_case_punct_only("word", "new").alias("case_punct"), text.grammar_title("word", "new").alias("grammar"), text.cap_punct_title("word", "new").alias("cappunct"))


@query(f"""WITH {_LEX}, w AS (SELECT word, lower(word) AS low FROM {_VOCABULARY})
SELECT word, low IN (SELECT word FROM known) OR (length(word) % 2 = 0 AND (length(word) % 3 = 0 OR length(word) % 4 = 0 OR length(word) % 5 = 0)) AS valid FROM w""")
def word_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another engine is asked about words of even length: it fails, accepts, or offers the word itself, by length."""
    words, n = _vocabulary(spark, sf_dir), F.length("word")
    said = words.where(n % 2 == 0).select("word", F.when(n % 3 == 0, F.lit(None)).otherwise(n % 4 == 0).alias("accepted"), F.when(n % 5 == 0, F.upper("word")).otherwise("?").alias("suggestion"))
    return spelling.validity(words, _known(spark, sf_dir), said).select("word", "valid")


@query(f"WITH {_SPANS} SELECT doc_id, f AS \"from\", t AS \"to\", category FROM sp WHERE status = 'pending' AND category = 'spelling'")
def pending_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.pending(_rule_spans(spark, sf_dir), "spelling").select("doc_id", "from", "to", "category")


@query(f"""WITH {_tokens_sql('documents', 'doc_id')}, c AS (SELECT doc_id, pos, s, word, unnest([upper(word), word || '.']) AS new FROM tok)
SELECT doc_id, pos, new FROM c WHERE word <> new AND {_LETTERS_ONLY.format('word')} = {_LETTERS_ONLY.format('new')} AND length({_LETTERS_ONLY.format('new')}) > 0
    AND NOT ((s < 20 OR (s >= 50 AND s < 90)) AND lower(word) <> lower(new))""")
def heading_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 20), (50, 90))))
    rows = spelling.tokens(_docs(spark, sf_dir)).select("doc_id", "pos", "start", "word", F.explode(F.array(F.upper("word"), F.concat("word", F.lit(".")))).alias("new"))
    return rows.where(spans.keep_cap_punct(F.col("word"), F.col("new"), F.col("start"), headings)).select("doc_id", "pos", "new")


@query(f"""WITH {_tokens_sql('documents', 'doc_id')} SELECT doc_id, pos, md5(substr(text, greatest(0, s - 200) + 1, s - greatest(0, s - 200)) || '[MASK]' || substr(text, e + 1, 200)) AS digest,
    CASE WHEN s >= length(text) // 2 THEN (length(text) // 2) * 3 - 1 ELSE s * 3 + 1 END AS from_offset,
    CASE WHEN e >= length(text) // 2 THEN (length(text) // 2) * 3 - 1 ELSE (e - 1) * 3 + 2 END AS to_offset FROM tok WHERE pos < 40 AND length(text) >= 2""")
def masked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets through a map of half of each text, in which character i stands at 3 i + 1."""
    docs = _docs(spark, sf_dir)
    rows = spelling.tokens(docs).where("pos < 40").join(docs.where("length(text) >= 2").withColumn("m", F.expr("transform(sequence(0, length(text) div 2 - 1), i -> cast(i * 3 + 1 as int))")), "doc_id")
    return rows.select("doc_id", "pos", F.md5(text.masked_context("text", "start", "end")).alias("digest"), text.map_offset("start", "m").cast("long").alias("from_offset"), text.map_offset("end", "m", True).cast("long").alias("to_offset"))


@query(f"""WITH {_tokens_sql('documents', 'doc_id')}, p AS (SELECT DISTINCT lower(word) AS a, lower(lead(word) OVER (PARTITION BY doc_id ORDER BY pos)) AS b FROM tok),
q AS (SELECT a, unnest([b, a[2:2] || a[1:1] || a[3:], a || 'x']) AS b FROM p WHERE regexp_matches(a, '^[a-z]+$') AND regexp_matches(b, '^[a-z]+$'))
SELECT DISTINCT a, b, levenshtein(a, b) AS plain, CASE WHEN damerau_levenshtein(a, b) = 1 THEN 1 ELSE levenshtein(a, b) END AS effective FROM q""")
def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    pairs = spelling.tokens(_docs(spark, sf_dir)).select(F.lower("word").alias("a"), F.lower(F.lead("word").over(w)).alias("b")).distinct().where("a rlike '^[a-z]+$' and b rlike '^[a-z]+$'")
    rows = pairs.select("a", F.explode(F.array("b", F.expr("concat(substr(a, 2, 1), substr(a, 1, 1), substr(a, 3))"), F.expr("concat(a, 'x')"))).alias("b")).distinct()
    return rows.select("a", "b", edits.levenshtein("a", "b").cast("long").alias("plain"), edits.effective_distance("a", "b").cast("long").alias("effective"))


@query(f"""WITH {_PAIRS}, o AS (SELECT typed, unnest([left(typed, length(typed) - 1) || 'zz', 'the', reverse(typed)]) AS cand FROM typed WHERE regexp_matches(typed, '^[a-z]+$')),
f AS (SELECT DISTINCT o.typed, o.cand, coalesce(k.freq, 0) AS freq, CASE WHEN damerau_levenshtein(o.typed, o.cand) = 1 THEN 1 ELSE levenshtein(o.typed, o.cand) END AS ed
    FROM o LEFT JOIN known k ON k.word = o.cand WHERE o.cand <> o.typed AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.typed = o.typed AND p.cand = o.cand)),
s AS (SELECT typed, cand, freq, ed FROM pairs UNION ALL SELECT * FROM f),
g AS (SELECT *, 0.3::DOUBLE * ln(freq + 1) + 0.5::DOUBLE * (1.0::DOUBLE / (1 + ed)) AS raw FROM s WHERE freq > 0 OR ed = 1)
SELECT typed, cand, ed::BIGINT AS ed, freq, round(raw, 6) AS score, row_number() OVER (PARTITION BY typed ORDER BY raw DESC, cand) AS rank FROM g""")
def suggested_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool with a suggester's offers: words outside the lexicon count with frequency 0 and go unless one edit away."""
    known = _known(spark, sf_dir)
    typed = spelling.unknown_vocabulary(_docs(spark, sf_dir), known)
    offers = F.explode(F.array(F.expr("concat(left(typed, length(typed) - 1), 'zz')"), F.lit("the"), F.reverse("typed")))
    offered = typed.where("typed rlike '^[a-z]+$'").select("typed", offers.alias("suggestion"))
    ranked = spelling.rank_candidates(spelling.candidate_pool(typed, known, offered))
    return ranked.select("typed", "cand", F.col("ed").cast("long").alias("ed"), "freq", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_tokens_sql('documents', 'doc_id')} SELECT doc_id, pos, a AS "from", greatest(a, b) AS "to" FROM (SELECT doc_id, pos,
    CASE WHEN s <= 10 THEN s WHEN s < 13 THEN 15 ELSE s + 2 END AS a, CASE WHEN e <= 10 THEN e WHEN e < 13 THEN 10 ELSE e + 2 END AS b FROM tok)""")
def span_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans after three characters at offset 10 gave way to five others."""
    docs = _docs(spark, sf_dir)
    rows = spelling.tokens(docs).select("doc_id", "pos", F.col("start").alias("from"), F.col("end").alias("to"))
    return spans.remap(rows, docs.select("doc_id", F.lit(10).alias("at"), F.lit(3).alias("removed"), F.lit(5).alias("inserted"))).select("doc_id", "pos", "from", "to")


# --- Sources, labels, vectors -----------------------------------------------------------------------------------------
@query(f"""WITH {_tokens_sql('documents', 'doc_id')}, l AS (SELECT doc_id * 100000 + pos AS n, CASE WHEN pos % 7 = 0 THEN chr(9) || '5' WHEN pos % 7 = 1 THEN word ELSE ' ' || upper(word) || ' ' || chr(9) || CASE pos % 3 WHEN 0 THEN 'x' ELSE pos || 'y' END END AS v FROM tok)
SELECT lower(trim(split_part(v, chr(9), 1))) AS word, arg_max(coalesce(try_cast(regexp_extract(split_part(v, chr(9), 2), '^([0-9]+)', 1) AS BIGINT), 0), n) AS freq FROM l WHERE instr(v, chr(9)) > 1 GROUP BY 1""")
def lexicon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pos") % 7
    value = F.when(p == 0, "\t5").when(p == 1, F.col("word")).otherwise(F.concat(F.lit(" "), F.upper("word"), F.lit(" \t"), F.when(F.col("pos") % 3 == 0, "x").otherwise(F.concat(F.col("pos").cast("string"), F.lit("y")))))
    return readers.parse_lexicon(spelling.tokens(_docs(spark, sf_dir)).select(value.alias("value"), (F.col("doc_id") * 100000 + F.col("pos")).alias("pos")))


@query(f"""WITH {_tokens_sql('documents', 'doc_id')}, l AS (SELECT CASE pos % 4 WHEN 0 THEN '# ' || word WHEN 1 THEN word || chr(9) || '3' WHEN 2 THEN ' ' || word ELSE '' END AS v FROM tok)
SELECT DISTINCT lower(trim(split_part(v, chr(9), 1))) AS word FROM l WHERE NOT starts_with(trim(v), '#') AND trim(split_part(v, chr(9), 1)) <> ''""")
def word_list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pos") % 4
    value = F.when(p == 0, F.concat(F.lit("# "), "word")).when(p == 1, F.concat("word", F.lit("\t3"))).when(p == 2, F.concat(F.lit(" "), "word")).otherwise("")
    return readers.parse_word_list(spelling.tokens(_docs(spark, sf_dir)).select(value.alias("value")))


@query("SELECT doc_id, md5('SET UTF-8' || chr(10) || 'SFX ' || replace(text, chr(10), ' ') || chr(10) || 'NEEDAFFIX b' || chr(10) || 'end') AS digest FROM documents")
def affix_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An affix file around each text: its first NEEDAFFIX line goes, as does `,1` at the ends of lines."""
    file = F.concat(F.lit("SET UTF-8,1\nNEEDAFFIX a\nSFX "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(",1\nNEEDAFFIX b\nend,1"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(readers.clean_affixes(file)).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest, false AS has_break FROM documents")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as lines of the text sink, and read back."""
    rows = _docs(spark, sf_dir).select("doc_id", readers.line_of(F.col("text")).alias("line"))
    return rows.select("doc_id", F.md5(readers.text_of(F.col("line"))).alias("digest"), F.col("line").rlike("[\r\n]").alias("has_break"))


@query("""WITH c AS (SELECT * FROM (VALUES ('web', 'eu', 'sarea'), ('web', 'es', 'red'), ('wiki', 'eu', 'wikia'), ('code', 'fr', 'code')) AS v(path, lang, label)),
d AS (SELECT doc_id, source AS path, CASE WHEN lang IN ('es', 'fr') THEN lang ELSE 'eu' END AS l FROM documents)
SELECT doc_id, coalesce(c.label, f.label, d.path) AS label FROM d LEFT JOIN c ON c.path = d.path AND c.lang = d.l LEFT JOIN c f ON f.path = d.path AND f.lang = 'eu'""")
def localized_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (("web", "eu", "sarea"), ("web", "es", "red"), ("wiki", "eu", "wikia"), ("code", "fr", "code"))
    catalog = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("path"), F.lit(b).alias("lang"), F.lit(c).alias("label")) for a, b, c in rows))))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), labels.known_language(F.concat(F.upper("lang"), F.lit("-XX")), ("es", "fr")).alias("lang"))
    return labels.localized(docs, catalog).select("doc_id", "label")


@query("""WITH p AS (SELECT vec_id // 10 AS word, vec_id * 7 % 600 AS id FROM embeddings), u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings),
m AS (SELECT word, d, avg(x) AS m FROM p JOIN u ON u.vec_id = p.id WHERE p.id < 400 GROUP BY 1, 2),
c AS (SELECT word, sum(x * m) / ((sqrt(sum(x * x)) + 1e-8) * (sqrt(sum(m * m)) + 1e-8)) AS s FROM m JOIN u ON u.vec_id = m.word AND u.d = m.d GROUP BY 1)
SELECT word, round(s, 6) AS score, round((s + 1) / 2, 6) AS confidence FROM c""")
def subword_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as means of their pieces' vectors, ids from 400 on having none, against a vector of the word itself."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    means = spelling.mean_vectors(rows.select(F.expr("id div 10").alias("word"), F.expr("id * 7 % 600").alias("id")), rows, 400, "word")
    met = means.join(rows.select(F.col("id").alias("word"), F.col("vector").alias("own")), "word").select("word", vectors.cosine("own", "vector").alias("s"))
    return met.select("word", F.round("s", 6).alias("score"), F.round(edits.spelling_confidence("s"), 6).alias("confidence"))


@query("SELECT vec_id // 8 AS doc_id, vec_id, CAST(vec_id % 8 // 2 AS INTEGER) AS word_id FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 8 < 6")
def subword_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight subwords a document, two a word, the last two of no word."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("doc_id"), "vec_id", F.col("vec_id").alias("tok"), F.when(F.col("vec_id") % 8 < 6, F.expr("cast(vec_id % 8 div 2 as int)")).alias("word_id"))
    return tagging.first_subwords(rows).select("doc_id", "vec_id", "word_id")


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^{text.SPACES}]+') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
c AS (SELECT doc_id, i, sum((length(x) + 2) // 3) OVER (PARTITION BY doc_id ORDER BY i) - (length(x) + 2) // 3 AS before, (length(x) + 2) // 3 AS n FROM u)
SELECT doc_id, CAST(sum(least(n, 128 - before)) AS BIGINT) AS pieces, CAST(max(i) AS BIGINT) AS last_word FROM c WHERE before < 128 GROUP BY doc_id""")
def subword_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in pieces of three characters, at most 128 pieces a text."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / 3).cast("int")), lambda i: F.substr(x, i * 3 + 1, F.lit(3)))
    rows = _docs(spark, sf_dir).select("doc_id", text.plain_tokens("text").alias("w")).select("doc_id", tagging.subword_ids("w", cut).alias("p")).where(F.size("p") > 0)
    return rows.select("doc_id", F.size("p").cast("long").alias("pieces"), F.array_max(F.transform("p", lambda x: x["word_id"])).cast("long").alias("last_word"))


@query("SELECT vec_id // 8 AS doc_id, round(coalesce(avg(CASE WHEN label % 2 = 0 THEN embedding[1]::DOUBLE END), 1.0), 6) AS match_rate FROM embeddings GROUP BY 1")
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("doc_id"), F.when(F.col("label") % 2 == 0, F.get("embedding", F.lit(0)).cast("double")).alias("match_rate"))
    return evaluate.mean_match_rate(rows).select("doc_id", F.round("match_rate", 6).alias("match_rate"))


@query("SELECT doc_id::VARCHAR AS id, 'new' AS title, md5(text) AS digest, 5 AS updated FROM documents WHERE doc_id = 7")
def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("old").alias("title"), F.col("text").alias("content"), F.lit(1).alias("createdAt"), F.lit(1).alias("updatedAt"))
    return readers.get_document(readers.update_document(docs, "7", 5, title="new"), "7").select("id", "title", F.md5("content").alias("digest"), F.col("updatedAt").alias("updated"))

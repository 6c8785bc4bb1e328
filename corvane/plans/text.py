"""Queries over documents, pages, conversations and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import patterns
from corvane.functions import text as X
from corvane.operators import search, totals
from corvane.plans.registry import query, table

_W = "regexp_extract_all(lower(text), '[A-Za-zÀ-ÖØ-öø-ÿ]+')"


def _list(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_COUNTS = ", ".join(f"len(list_filter(w, lambda x: x IN {_list(v)})) AS n_{k}" for k, v in X.FUNCTION_WORDS.items())
_LANG = f"""SELECT doc_id, n_en, n_de, n_fr, n_es, CASE greatest(n_en, n_de, n_fr, n_es) WHEN n_en THEN 'en' WHEN n_de THEN 'de' WHEN n_fr THEN 'fr' ELSE 'es' END AS guessed
       FROM (SELECT doc_id, {_COUNTS} FROM (SELECT doc_id, {_W} AS w FROM documents))"""


def _guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", X.words(F.col("text")).alias("w"))
    n = X.function_word_counts(F.col("w"))
    counted = d.select("doc_id", "lang", *[v.cast("long").alias(f"n_{k}") for k, v in n.items()])
    top = F.greatest("n_en", "n_de", "n_fr", "n_es")
    return counted.withColumn("guessed", F.when(F.col("n_en") == top, "en").when(F.col("n_de") == top, "de").when(F.col("n_fr") == top, "fr").otherwise("es"))


@query(_LANG)
def language_by_function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guessed(spark, sf_dir).drop("lang")


@query(f"SELECT d.lang, g.guessed, count(*) AS n_docs FROM documents d JOIN ({_LANG}) g ON d.doc_id = g.doc_id GROUP BY ALL")
def language_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guessed(spark, sf_dir).groupBy("lang", "guessed").agg(F.count(F.lit(1)).alias("n_docs"))


@query(f"SELECT word, count(*) AS n_occurrences, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({_W}) AS word FROM documents) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3")
def word_and_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted per document first, so the second shuffle has a row for each word and document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.words(F.col("text"))).alias("word"))
    by = d.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("word").agg(F.sum("n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_docs")).where("n_docs >= 3")


@query(
    f"""SELECT phrase, count(*) AS n_occurrences, count(DISTINCT item_id) AS n_items FROM (SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM (SELECT item_id, {_W} AS w FROM benchmark)) GROUP BY 1"""
)
def phrase_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", X.words(F.col("text")).alias("w")).where(F.size("w") > 1)
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
    return b.select("item_id", F.explode(X.let(F.col("w"), pairs)).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n_occurrences"), F.countDistinct("item_id").alias("n_items"))


@query(
    f"""WITH s AS (SELECT doc_id, text, len({_W}) AS n_words, list_filter(list_transform(string_split_regex(text, '[.?!]+'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '') AS ss FROM documents)
       SELECT doc_id, n_words, len(ss) AS n_sentences, CASE WHEN len(ss) > 0 THEN list_max(list_transform(ss, lambda x: len(x))) END AS longest, len(text) - len(replace(text, ',', '')) AS n_commas,
              CASE WHEN n_words > 0 THEN round(CAST(len(text) - len(replace(text, ',', '')) AS DOUBLE) * 1000 / n_words, 1) END AS commas_per_1000 FROM s"""
)
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("n_words"), X.sentences(F.col("text")).alias("ss"), (F.length("text") - F.length(F.replace(F.col("text"), F.lit(","), F.lit("")))).cast("long").alias("n_commas"))
    longest = F.array_max(F.transform("ss", lambda s: F.length(s)))
    return d.select("doc_id", "n_words", F.size("ss").cast("long").alias("n_sentences"), longest.alias("longest"), "n_commas", F.when(F.col("n_words") > 0, F.round(F.col("n_commas").cast("double") * 1000 / F.col("n_words"), 1)).alias("commas_per_1000"))


_MAIL = "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}"
_IP = "\\b(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}\\b"
_PHONE = "\\+[1-9][0-9 ()-]{7,}[0-9]"


@query(
    f"""SELECT doc_id, len(regexp_extract_all(text, '{_MAIL}')) AS n_mail, len(regexp_extract_all(text, '{_IP}')) AS n_ip, len(regexp_extract_all(text, '{_PHONE}')) AS n_phone, array_to_string(regexp_extract_all(text, '{_MAIL}'), '|') AS mails FROM documents"""
)
def structured_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, every = table(spark, sf_dir, "documents"), lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    return d.select("doc_id", F.size(every(_MAIL)).cast("long").alias("n_mail"), F.size(every(_IP)).cast("long").alias("n_ip"), F.size(every(_PHONE)).cast("long").alias("n_phone"), F.array_join(every(_MAIL), "|").alias("mails"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '{_MAIL}', '[mail]', 'g'), '{_IP}', '[ip]', 'g') AS masked FROM documents")
def masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", _MAIL, "[mail]"), _IP, "[ip]").alias("masked"))


@query(
    f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS value FROM documents), f AS (SELECT lower(value) AS value, min(doc_id) AS first_doc, count(*) AS n FROM m GROUP BY 1)
       SELECT value, first_doc, n, row_number() OVER (ORDER BY first_doc, value) AS number FROM f"""
)
def token_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values numbered by the document that has them first."""
    m = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0))).alias("value"))
    f = m.groupBy(F.lower("value").alias("value")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    return totals.numbered(f, [F.col("first_doc"), F.col("value")], F.floor(F.col("first_doc") / 100_000), "number")


@query()
def structured_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patterns with their checkers, by document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(patterns.spans(F.col("text"))).alias("s"))
    return d.select("doc_id", "lang", "s.start", "s.end", "s.cls", "s.form")


@query()
def structured_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structured_spans(spark, sf_dir)
    return found.groupBy("lang", "cls").agg(F.count(F.lit(1)).alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"))


@query()
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", patterns.redacted(F.col("text")).alias("redacted"))


_STRIP = r"regexp_replace(html, '(?is)<(script|style|template)[^>]*>.*?</(script|style|template)>', ' ', 'g')"
_STRIP = rf"regexp_replace({_STRIP}, '(?s)<!--.*?-->', ' ', 'g')"
_STRIP = rf"regexp_replace({_STRIP}, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav)[^>]*>', chr(10), 'g')"
_STRIP = rf"regexp_replace({_STRIP}, '<[^>]*>', '', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_e}', '{_c}')"
_STRIP = rf"trim(regexp_replace(regexp_replace({_STRIP}, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'))"


@query(f"SELECT page_id, md5({_STRIP}) AS text_md5, len({_STRIP}) AS n_chars FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("t"))
    return p.select("page_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query(
    r"""SELECT page_id, len(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS n_comments, coalesce(array_to_string(regexp_extract_all(html, '(?i)(href|src|alt|title|content|value)="([^"]*)"', 2), '|'), '') AS attribute_values,
               regexp_matches(html, '(?i)<[a-z][^>]*>') AND regexp_matches(html, '(?i)</[a-z]+>') AS looks_html FROM pages"""
)
def html_hidden_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.size(X.html_comments(F.col("html"))).cast("long").alias("n_comments"), F.array_join(X.html_attributes(F.col("html")), "|").alias("attribute_values"), X.looks_html(F.col("html")).alias("looks_html"))


@query(
    r"""SELECT page_id, link, allowed FROM (SELECT page_id, link, host, host IN (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) FROM pages) AS allowed
        FROM (SELECT page_id, link, regexp_extract(link, '^[a-z]+://([^/]+)', 1) AS host FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages)))"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, and whether their host is one of the table's own hosts."""
    p = table(spark, sf_dir, "pages")
    host = lambda c: F.regexp_extract(c, "^[a-z]+://([^/]+)", 1)
    hosts = p.select(host("url").alias("host")).distinct().withColumn("known", F.lit(True))
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")).withColumn("host", host("link"))
    return links.join(hosts, "host", "left").select("page_id", "link", F.coalesce("known", F.lit(False)).alias("allowed"))


@query(
    """SELECT role, count(*) AS n_turns, count(*) FILTER (WHERE regexp_matches(rtrim(text), '\\?$')) AS n_questions, round(100.0 * count(*) FILTER (WHERE regexp_matches(rtrim(text), '\\?$')) / count(*), 1) AS percent, count(DISTINCT conv_id) AS n_conversations FROM conversations GROUP BY role"""
)
def question_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("q", F.rtrim("text").rlike("\\?$"))
    n, q = F.count(F.lit(1)), F.count_if("q")
    return c.groupBy("role").agg(n.alias("n_turns"), q.alias("n_questions"), F.round(F.lit(100.0) * q / n, 1).alias("percent"), F.countDistinct("conv_id").alias("n_conversations"))


@query("""SELECT conv_id, turn AS last_turn, role, len(text) AS n_chars, CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE 'session' END AS whose_move FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS n FROM conversations) WHERE n = 1""")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max(F.struct("turn", "text", "role")).alias("b"))
    move = F.when(F.col("b.role") == "user", "assistant").when(F.col("b.role") == "assistant", "user").otherwise("session")
    return last.select("conv_id", F.col("b.turn").alias("last_turn"), F.col("b.role").alias("role"), F.length("b.text").cast("long").alias("n_chars"), move.alias("whose_move"))


_PHRASES = [("number", "[0-9]"), ("mail", "@"), ("table", "\\|"), ("shout", "[A-Z]{12,}"), ("list", "(?m)^\\s*[-*] ")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in _PHRASES) + " ELSE 'plain' END AS cls FROM documents")
def phrase_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule in order that a text meets."""
    cls = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in _PHRASES], F.lit("plain"))
    return table(spark, sf_dir, "documents").select("doc_id", cls.alias("cls"))


@query(
    r"""SELECT n_nationkey, array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ('the', 'a', 'an', 'of', 'for', 'service')), lambda x: regexp_replace(x, '(ing|er|s)$', '')), '') AS name_key,
               array_to_string(list_transform(regexp_extract_all(lower(n_name || n_nationkey), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN lpad(CAST(len(ltrim(p, '0')) AS VARCHAR), 4, '0') || ltrim(p, '0') ELSE p END), '') AS natural_key FROM nation"""
)
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", X.name_key(F.col("n_name")).alias("name_key"), X.natural_key(F.concat("n_name", F.col("n_nationkey").cast("string"))).alias("natural_key"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_acctbal AS DECIMAL(18,2)) END AS amount, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 THEN md5(s_name) END AS md5 FROM supplier""")
def parsed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written for people read back (a decimal comma is unreadable), and etags that are an MD5."""
    s = table(spark, sf_dir, "supplier")
    text = F.concat(F.format_number(F.col("s_acctbal").cast("decimal(18,2)"), 2), F.lit(" EUR"))
    text = F.when(F.col("s_suppkey") % 5 == 0, F.regexp_replace(F.regexp_replace(text, ",", ""), "\\.", ",")).otherwise(text)
    etag = F.when((F.col("s_suppkey") % 3 == 0) & (F.col("s_suppkey") % 5 != 0), F.concat(F.lit('"'), F.md5(F.col("s_name").cast("binary")), F.lit('"'))).otherwise(F.concat(F.md5(F.col("s_name").cast("binary")), F.lit("-12")))
    return s.select("s_suppkey", X.parse_amount(text).cast("decimal(18,2)").alias("amount"), X.md5_of_etag(etag).alias("md5"))


@query("SELECT item_id, round(-list_sum(list_transform(map_values(m), lambda c: c / n * log2(c / n))), 6) AS entropy FROM (SELECT item_id, len(text) AS n, list_histogram(string_split(text, '')) AS m FROM benchmark)".replace("list_histogram(string_split(text, ''))", "list_aggregate(regexp_extract_all(text, '(?s).'), 'histogram')"))
def character_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(X.entropy(F.col("text")), 6).alias("entropy"))


@query(
    f"""WITH q AS (SELECT item_id, list_distinct({_W}) AS w FROM benchmark), t AS (SELECT item_id, unnest(w) AS word FROM q), d AS (SELECT doc_id, list_distinct({_W}) AS w FROM documents), u AS (SELECT doc_id, len(w) AS size, unnest(w) AS word FROM d),
        n AS (SELECT count(*) AS n_docs FROM documents), f AS (SELECT word, count(*) AS df FROM u GROUP BY 1), wt AS (SELECT t.item_id, t.word, pow(ln(n_docs / (1.0 + coalesce(df, 0))) + 1, 1.5) AS weight FROM t LEFT JOIN f ON t.word = f.word CROSS JOIN n),
        s AS (SELECT item_id, sum(weight) AS whole, count(*) AS size FROM wt GROUP BY 1),
        h AS (SELECT wt.item_id, u.doc_id, sum(wt.weight) AS got, count(*) AS n_shared, any_value(u.size) AS size FROM wt JOIN u ON wt.word = u.word GROUP BY 1, 2),
        r AS (SELECT h.item_id, h.doc_id, round(got / whole, 6) AS score, round(CAST(n_shared AS DOUBLE) / (s.size + h.size - n_shared), 6) AS overlap FROM h JOIN s ON h.item_id = s.item_id)
        SELECT item_id, "rank", doc_id, score, overlap FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, overlap DESC, doc_id) AS "rank" FROM r) WHERE "rank" <= 10"""
)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for each benchmark item by the IDF-weighted share of the item's words, ties by Jaccard, then id."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(X.words(F.col("text"))).alias("w"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(X.words(F.col("text"))).alias("w"))
    return search.ranked(q, "item_id", d, "doc_id", 10)


@query(
    f"""WITH b AS (SELECT item_id, list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM (SELECT item_id, {_W} AS w FROM benchmark)), bg AS (SELECT item_id, len(g) AS n_grams, unnest(g) AS gram FROM b),
        d AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM (SELECT doc_id, {_W} AS w FROM documents)), dg AS (SELECT doc_id, unnest(g) AS gram FROM d)
        SELECT bg.item_id, dg.doc_id, count(*) AS n_shared, round(CAST(count(*) AS DOUBLE) / any_value(n_grams), 4) AS share FROM bg JOIN dg ON bg.gram = dg.gram GROUP BY 1, 2 HAVING CAST(count(*) AS DOUBLE) / any_value(n_grams) >= 0.3"""
)
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 30 % of an item's eight-word sequences."""
    items, docs = (table(spark, sf_dir, t).select(i, X.words(F.col("text")).alias("w")) for t, i in (("benchmark", "item_id"), ("documents", "doc_id")))
    return search.containment(search.grams(items, "item_id", 8), "item_id", search.grams_among(docs, "doc_id", 8, items), "doc_id", 0.3)


@query(
    """SELECT quality, toxic, count(*) AS n_docs, count(*) FILTER (WHERE flagged) AS n_flagged, round(100.0 * count(*) FILTER (WHERE flagged) / count(*), 1) AS percent FROM (SELECT l.quality, l.toxic, regexp_matches(d.text, '[#$%&*]{3}|!!|\\|') AS flagged FROM labels l JOIN documents d ON l.doc_id = d.doc_id) GROUP BY 1, 2"""
)
def rule_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule against labels: documents flagged by label."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike("[#$%&*]{3}|!!|\\|").alias("flagged"))
    n, hit = F.count(F.lit(1)), F.count_if("flagged")
    return table(spark, sf_dir, "labels").join(d, "doc_id").groupBy("quality", "toxic").agg(n.alias("n_docs"), hit.alias("n_flagged"), F.round(F.lit(100.0) * hit / n, 1).alias("percent"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x{00ad}\\x{200b}\\x{200c}\\x{200d}\\x{2060}\\x{feff}]', '', 'g'), '([a-zà-öø-ÿ])-\n([a-zà-öø-ÿ])', '\\1\\2', 'g')) AS normal_md5 FROM documents")
def normalised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normal_lines(F.col("text")).cast("binary")).alias("normal_md5"))


@query("SELECT doc_id, len(p) AS n_pieces, list_max(list_transform(p, lambda x: len(x))) AS longest, array_to_string(p, '') = text AS whole FROM (SELECT doc_id, text, regexp_extract_all(text, '(?s).{1,500}(?:\\s|$)|.{1,500}') AS p FROM documents)")
def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of about 500 characters, which together are the whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", X.pieces(F.col("text"), 500).alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("n_pieces"), F.array_max(F.transform("p", lambda x: F.length(x))).cast("long").alias("longest"), (F.array_join("p", "") == F.col("text")).alias("whole"))

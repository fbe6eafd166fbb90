"""Registered queries on texts, words, taxonomies and vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relispan.functions import clean as C
from relispan.operators import annotate, causal, entities, similarity
from relispan.plans.catalog import query, r6
from relispan.plans.workflow import CONJECTURES, NEGATIONS

# ---- cleaning


def _cleaned(read, *steps, table="documents", key="doc_id", column="text", **options) -> DataFrame:
    text = C.clean(F.coalesce(F.col(column), F.lit("")), list(steps), options, prepare=False)
    return _digest(read(table).select(key, text.alias("t")), key)


def _digest(texts: DataFrame, key: str) -> DataFrame:
    """(key, cleaned, n) of texts (key, t). Steps stand in one column of their own: named in two they are run twice."""
    return texts.select(key, F.md5("t").alias("cleaned"), F.length("t").alias("n"))


def _sub(*pairs: tuple[str, str], table="documents", key="doc_id", column="text") -> str:
    e = f"coalesce({column}, '')"
    for p, to in pairs:
        p = p.replace("'", "''")
        e = f"regexp_replace({e}, '{p}', '{to}', 'g')"
    return f"SELECT {key}, md5(t) AS cleaned, CAST(length(t) AS INTEGER) AS n FROM (SELECT {key}, {e} AS t FROM {table})"


@query(_sub((r"(?:mailto:)?[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "_EMAIL_")))
def clean_emails(read):
    return _cleaned(read, "emails")


@query(_sub((r"(?:https?://|ftp://|www\d{0,3}\.)[A-Za-z0-9.-]+(?:/[^\s<>()\[\]\"']*)?", "_URL_"), table="pages", key="page_id", column="html"))
def clean_urls(read):
    return _cleaned(read, "urls", table="pages", key="page_id", column="html")


@query(_sub((r"\{[^{}]*\}", ""), (r"\[[^\[\]]*\]", ""), (r"\([^()]*\)", ""), (r"\{[^{}]*\}", ""), (r"\[[^\[\]]*\]", ""), (r"\([^()]*\)", ""), (r"\{[^{}]*\}", ""), (r"\[[^\[\]]*\]", ""), (r"\([^()]*\)", "")))
def clean_brackets(read):
    return _cleaned(read, "brackets")


@query(_sub((r"[,;:!?]+", " ")))
def clean_punctuation(read):
    return _cleaned(read, "punctuation", punctuation={"only": [",", ";", ":", "!", "?"]})


@query(_sub((r"\p{Sc}", "_CUR_")))
def clean_currency(read):
    return _cleaned(read, "currency_symbols")


@query(_sub((r"[ \t]*(?:\r\n|[\n\r])\s*", "\n"), (r"[ \t]+", " "), (r"^\s+|\s+$", "")))
def clean_whitespace(read):
    return _cleaned(read, "whitespace")


@query(_sub((r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", ""), (r"<[^<>]*>", ""), table="pages", key="page_id", column="html"))
def clean_html(read):
    return _cleaned(read, "html_tags", table="pages", key="page_id", column="html")


@query("SELECT doc_id, md5(t) AS cleaned, CAST(length(t) AS INTEGER) AS n FROM (SELECT doc_id, strip_accents(coalesce(text, '')) AS t FROM documents)")
def clean_accents(read):
    return _cleaned(read, "accents")


@query("SELECT doc_id, md5(t) AS cleaned, CAST(length(t) AS INTEGER) AS n FROM (SELECT doc_id, translate(coalesce(text, ''), 'ʼ‘’´`“”„«»', '\'\'\'\'\'\'\'\'\'\'\"\"\"\"\"') AS t FROM documents)")
def clean_quotes(read):
    return _cleaned(read, "quotation_marks")


@query("SELECT doc_id, md5(t) AS cleaned, CAST(length(t) AS INTEGER) AS n FROM (SELECT doc_id, nfc_normalize(coalesce(text, '')) AS t FROM documents)")
def clean_unicode(read):
    return _cleaned(read, "unicode")


@query(_sub((r"(?m)^[ \t]*[‣⁃⌁⍁∙▪●◦•][ \t]*", "- ")))
def clean_bullets(read):
    return _cleaned(read, "bullet_points")


@query(_sub((r"([0-9A-Za-z_]+[A-Za-z_])-\s+([A-Za-z_][0-9A-Za-z_]+)", r"\1\2")))
def clean_hyphenated(read):
    return _cleaned(read, "hyphenated_words")


@query(_sub((r"(?:\.){2,}", ".")))
def clean_repeating(read):
    return _cleaned(read, "repeating_chars", repeating_chars={"chars": "."})


@query(_sub((r"[\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F300}-\x{1FAFF}]", "_EMOJI_")))
def clean_emojis(read):
    return _cleaned(read, "emojis")


@query(_sub((r"(^|[^0-9A-Za-z_#&/])#([0-9A-Za-z_]*[A-Za-z_][0-9A-Za-z_]*)", r"\1_TAG_"), table="pages", key="page_id", column="html"))
def clean_hashtags(read):
    return _cleaned(read, "hashtags", table="pages", key="page_id", column="html")


@query(_sub((r"(^|[^0-9A-Za-z_.%+-])@[A-Za-z0-9_]+", r"\1_USER_")))
def clean_handles(read):
    return _cleaned(read, "user_handles")


@query()
def clean_numerize(read):
    return _cleaned(read, "numerize")


@query()
def clean_default(read):
    return _cleaned(read, *C.DEFAULT)


@query(r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def html_title(read):
    return read("pages").select("page_id", F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query(_sub((r"[-A-Za-z0-9#/%]*[-0-9][-A-Za-z0-9#/%]*", "")))
def only_words(read):
    text = C.only_words(F.coalesce("text", F.lit("")))
    return _digest(read("documents").select("doc_id", text.alias("t")), "doc_id")


# ---- words and entities

_LOW = "[a-z0-9]+"
WORDS = "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents)"
FREQ = WORDS + ", v AS (SELECT word, count(*) AS n FROM w GROUP BY 1), top AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS r FROM v)"


def _top(read, low: int, high: int) -> DataFrame:
    """(word, r): the words of these ranks by frequency in documents; a short list by design."""
    v = entities.vocabulary(read("documents")).orderBy(F.desc("n"), "word").limit(high)
    return v.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "word"))).filter(F.col("r") >= low).select("word", "r")


@query(r"SELECT doc_id, CAST(count(*) AS BIGINT) AS n, count(DISTINCT t) AS kinds FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*|[^\sA-Za-z0-9]')) AS t FROM documents) GROUP BY 1")
def tokens(read):
    return entities.tokens(read("documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("word").alias("kinds"))


@query(f"{FREQ} SELECT word, n FROM v")
def vocabulary(read):
    return entities.vocabulary(read("documents"))


@query(f"{FREQ} SELECT word, round(1 - ln(n + 1) / ln((SELECT sum(n) FROM v) + 1), 6) AS ic FROM v")
def info_content(read):
    words = read("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_LOW), F.lit(0))).alias("word"))
    return similarity.information_content(words).withColumn("ic", r6("ic"))


_DICT = f"""{FREQ}, x AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*|[^\\sA-Za-z0-9]') AS t FROM documents),
y AS (SELECT doc_id, t[i] AS word, i - 1 AS start FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM x))"""


def _dictionary(read) -> DataFrame:
    top = _top(read, 20, 29)
    return entities.patterns(top.select(F.col("word").alias("phrase"), F.lit("part").alias("label"), F.concat(F.lit("e"), "r").alias("ent_id")))


@query(f"{_DICT} SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + 1 AS INTEGER) AS \"end\", y.word AS text, 'part' AS label, 'e' || r AS ent_id FROM y JOIN top ON y.word = top.word WHERE r BETWEEN 20 AND 29")
def dict_match_entities(read):
    return entities.match_entities(read("documents"), _dictionary(read))


@query(f"{_DICT} SELECT y.word AS text, count(*) AS n, count(DISTINCT doc_id) AS docs FROM y JOIN top ON y.word = top.word WHERE r BETWEEN 20 AND 29 GROUP BY 1")
def entity_counts(read):
    found = entities.match_entities(read("documents"), _dictionary(read))
    return found.groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("SELECT p_partkey AS id, p_name AS text, upper(split_part(p_name, ' ', 2)) AS alias FROM part")
def alias_lookup(read):
    part = read("part")
    names = part.select(F.upper("p_name").alias("alias"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("name")).distinct()
    return entities.resolve_aliases(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), names)


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z0-9-]+'), lambda w: regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]')), ' ') AS ids FROM documents")
def wo_id_tokens(read):
    return read("documents").select("doc_id", F.array_join(entities.identifiers(F.col("text")), " ").alias("ids"))


_TEMPORAL = entities.TEMPORAL


@query(rf"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i)\b({_TEMPORAL})\b', 1), '|') AS mentions FROM documents")
def temporal_mentions(read):
    return read("documents").select("doc_id", F.array_join(entities.temporal_mentions(F.col("text")), "|").alias("mentions"))


_UNIT_NAMES = "|".join(sorted({u for us in entities.UNITS.values() for u in us.split()}, key=lambda u: (-len(u), u)))


@query(rf"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i)\b([0-9]+(?:\.[0-9]+)? ?(?:{_UNIT_NAMES}))\b', 1), '|') AS mentions FROM documents")
def unit_mentions(read):
    return read("documents").select("doc_id", F.array_join(entities.unit_mentions(F.col("text")), "|").alias("mentions"))


@query(f"{FREQ}, b AS (SELECT DISTINCT item_id AS doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark) SELECT doc_id, word FROM b WHERE word NOT IN (SELECT word FROM v WHERE n > 5)")
def misspelled(read):
    return entities.misspelled(read("benchmark"), entities.vocabulary(read("documents")).filter("n > 5"), id_column="item_id").select("doc_id", "word")


@query(
    f"{FREQ}, known AS (SELECT word, n FROM v WHERE n > 20), b AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark) WHERE word NOT IN (SELECT word FROM known)), "
    "c AS (SELECT b.word, known.word AS correction, levenshtein(b.word, known.word) AS distance, row_number() OVER (PARTITION BY b.word ORDER BY levenshtein(b.word, known.word), n DESC, known.word) AS r FROM b JOIN known ON levenshtein(b.word, known.word) <= 2 AND length(known.word) >= 3) "
    "SELECT word, correction, CAST(distance AS INTEGER) AS distance FROM c WHERE r = 1"
)
def spell_candidates(read):
    known = entities.vocabulary(read("documents")).filter("n > 20")
    words = entities.misspelled(read("benchmark"), known, id_column="item_id").select("word")
    return entities.corrections(words, known.filter("length(word) >= 3"))


@query("SELECT p_partkey AS doc_id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN w = 'small' THEN 'sm full' WHEN w = 'ring' THEN 'rg full' ELSE w END), ' ') AS text FROM part")
def abbr_expand(read):
    part = read("part")
    word = F.explode(F.split(F.lower("p_name"), " ")).alias("abbreviation")
    pairs = part.select(word).distinct().filter(F.col("abbreviation").isin("small", "ring"))
    full = F.concat(F.when(F.col("abbreviation") == "small", "sm").otherwise("rg"), F.lit(" full"))
    return entities.expand_abbreviations(part, pairs.withColumn("full", full), text="p_name", id_column="p_partkey")


# ---- sentences, causes, statuses

_SENT = "WITH s AS (SELECT conv_id * 1000 + turn AS doc_id, 0 AS sent, text FROM conversations)"


def _sentences(read) -> DataFrame:
    """The turns of conversations as sentences."""
    return read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.lit(0).alias("sent"), "text")


@query(r"SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) FROM documents) GROUP BY 1")
def sentence_split(read):
    return entities.sentences(read("documents")).groupBy("doc_id").agg(F.count("*").alias("n"))


_LEX = f"""{FREQ}, c AS (SELECT conv_id * 1000 + turn AS doc_id, 0 AS sent, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM conversations),
x AS (SELECT doc_id, sent, i - 1 AS i, t[i] AS word FROM (SELECT doc_id, sent, t, unnest(range(1, len(t) + 1)) AS i FROM c)),
ent AS (SELECT word FROM top WHERE r BETWEEN 11 AND 60), rel AS (SELECT word AS keyword, CASE WHEN r % 2 = 0 THEN 'effect-relator' ELSE 'verb' END AS kind FROM top WHERE r BETWEEN 6 AND 10)"""


def _lexicons(read):
    top = _top(read, 6, 60)
    ent = top.filter("r >= 11").select("word")
    rel = top.filter("r <= 10").select(F.col("word").alias("keyword"), F.when(F.col("r") % 2 == 0, "effect-relator").otherwise("verb").alias("kind"))
    return ent, rel


@query(f"{_LEX} SELECT DISTINCT doc_id FROM x WHERE word IN (SELECT word FROM ent)")
def sentences_with_entity(read):
    ent, _ = _lexicons(read)
    words = causal.sentence_words(_sentences(read))
    return words.join(ent, "word", "left_semi").select("doc_id").distinct()


@query(
    f"{_LEX}, m AS (SELECT x.*, ent.word AS e, rel.keyword, kind FROM x LEFT JOIN ent ON x.word = ent.word LEFT JOIN rel ON x.word = rel.keyword), "
    "n AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id, sent ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(e IGNORE NULLS) OVER (PARTITION BY doc_id, sent ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM m) "
    "SELECT doc_id, sent, CAST(i AS INTEGER) AS i, keyword, CASE WHEN kind = 'effect-relator' THEN b ELSE a END AS cause, CASE WHEN kind = 'effect-relator' THEN a ELSE b END AS effect FROM n WHERE keyword IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL"
)
def causal_position(read):
    ent, rel = _lexicons(read)
    return causal.cause_effect(causal.sentence_words(_sentences(read)), ent, rel)


@query(
    f"{_LEX}, f AS (SELECT doc_id, sent, min(i) AS i, arg_min(word, i) AS relation FROM x WHERE word IN (SELECT keyword FROM rel) GROUP BY 1, 2) "
    "SELECT DISTINCT f.doc_id, f.sent, a.word AS subject, relation, b.word AS object FROM f JOIN x a ON a.doc_id = f.doc_id AND a.i < f.i JOIN x b ON b.doc_id = f.doc_id AND b.i > f.i WHERE a.word IN (SELECT word FROM ent) AND b.word IN (SELECT word FROM ent)"
)
def relation_triples(read):
    ent, rel = _lexicons(read)
    return causal.relation_triples(causal.sentence_words(_sentences(read)), ent, rel.select(F.col("keyword").alias("word")))


@query(f"{_LEX} SELECT doc_id, sent, string_agg(word, ' ' ORDER BY i) AS sequence FROM x WHERE word IN (SELECT word FROM ent) GROUP BY 1, 2")
def causal_sequences(read):
    ent, _ = _lexicons(read)
    found = annotate.causal_sequences(causal.sentence_words(_sentences(read)), ent)
    return found.select("doc_id", "sent", F.array_join("sequence", " ").alias("sequence"))


@query(
    f"{_LEX}, k AS (SELECT word, CASE WHEN r % 2 = 0 THEN 'the ' || word END AS alias FROM top WHERE r BETWEEN 11 AND 60), m AS (SELECT c.doc_id, c.sent, t, i - 1 AS i, t[i] AS entity FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM c) c), "
    "e AS (SELECT m.*, alias, count(*) OVER (PARTITION BY doc_id, sent) AS many FROM m JOIN k ON entity = word) "
    "SELECT doc_id, sent, entity, CAST(i AS INTEGER) AS i, CASE WHEN i = 0 THEN array_to_string(t[2:], ' ') WHEN alias IS NOT NULL THEN array_to_string(list_transform(t, lambda w: CASE WHEN w = entity THEN alias ELSE w END), ' ') "
    "WHEN many = 1 THEN array_to_string(list_filter(t, lambda w: w <> entity), ' ') END AS status, list_has_any(t, ['not', 'no', 'never']) AS negated, list_has_any(t, ['possible', 'likely', 'may', 'should', 'could']) AS conjecture FROM e"
)
def simple_status(read):
    top = _top(read, 11, 60)
    known = top.select("word", F.when(F.col("r") % 2 == 0, F.concat(F.lit("the "), "word")).alias("alias"))
    return causal.entity_status(_sentences(read), known, NEGATIONS, CONJECTURES)


@query(
    f"{_LEX}, m AS (SELECT x.*, word IN (SELECT keyword FROM rel) AS key FROM x WHERE word IN (SELECT word FROM ent) OR word IN (SELECT keyword FROM rel)) "
    "SELECT doc_id, sent, string_agg(CASE WHEN key THEN '[' || word || ']' ELSE word END, ' ' ORDER BY i) AS sequence FROM m GROUP BY 1, 2 HAVING bool_or(key)"
)
def simple_sequences(read):
    ent, rel = _lexicons(read)
    found = causal.entity_sequences(causal.sentence_words(_sentences(read)), ent, rel)
    return found.select("doc_id", "sent", F.array_join("sequence", " ").alias("sequence"))


@query(
    f"{FREQ}, f AS (SELECT word, 'w' || r AS fix FROM top WHERE r BETWEEN 5 AND 40) "
    "SELECT item_id AS doc_id, md5(string_agg(g || CASE WHEN fix IS NULL THEN w WHEN regexp_matches(w, '^[A-Z]') THEN upper(fix[1]) || substr(fix, 2) ELSE fix END, '' ORDER BY i)) AS corrected "
    "FROM (SELECT item_id, i, gaps[i] AS g, coalesce(ws[i], '') AS w FROM (SELECT item_id, string_split_regex(text, '[A-Za-z0-9]+') AS gaps, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws, unnest(range(1, len(string_split_regex(text, '[A-Za-z0-9]+')) + 1)) AS i FROM benchmark)) z LEFT JOIN f ON lower(z.w) = f.word GROUP BY 1"
)
def spell_correct(read):
    fixes = _top(read, 5, 40).select("word", F.concat(F.lit("w"), F.col("r").cast("string")).alias("correction"))
    fixed = entities.correct_text(read("benchmark"), fixes, id_column="item_id")
    return fixed.select("doc_id", F.md5("text").alias("corrected"))


@query("SELECT DISTINCT p_brand AS label, unnest([lower(p_type), replace(lower(p_type), '-', ' '), replace(lower(p_type), '-', '')]) AS entity FROM part")
def entity_library(read):
    return annotate.entity_library(read("part").select(F.col("p_brand").alias("label"), F.col("p_type").alias("entity")))


@query("SELECT lower(p_type) AS entity, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def shared_names(read):
    library = annotate.entity_library(read("part").select(F.col("p_brand").alias("label"), F.col("p_type").alias("entity")))
    return annotate.shared_names(library).select("entity", F.size("labels").cast("bigint").alias("n"))


@query(f"{_SENT} SELECT doc_id, sent, list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), ['possible', 'likely', 'may', 'should', 'could']) AS conjecture FROM s")
def conjecture_flag(read):
    return causal.word_flags(_sentences(read), ["possible", "likely", "may", "should", "could"], "conjecture")


@query(f"{_SENT} SELECT doc_id, sent, list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), ['not', 'no', 'never']) AS negated FROM s")
def negation_flag(read):
    return causal.word_flags(_sentences(read), ["not", "no", "never"], "negated")


@query(rf"{_SENT} SELECT doc_id, sent, trim(CASE WHEN regexp_matches(lower(text), '^the\b') THEN substr(text, 4) ELSE regexp_replace(text, '(?i)\bthe\b', '', 'g') END, ' ') AS status FROM s WHERE regexp_matches(lower(text), '\bthe\b')")
def phrase_status(read):
    return causal.phrase_status(_sentences(read), "the")


# ---- similarity

_PAIRS = """WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations),
p AS (SELECT conv_id * 1000 + turn AS pair_id, w AS a, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM c)"""


def _turn_pairs(read) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(_LOW), F.lit(0))
    c = read("conversations").select("conv_id", "turn", words.alias("a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return c.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "a", "b")


_JOINT = "list_transform(list_filter(list_concat(a, b), lambda x, i: list_position(list_concat(a, b), x) = i), lambda x: {f})"


@query(
    f"{_PAIRS}, o AS (SELECT pair_id, {_JOINT.format(f='coalesce(list_position(a, x), 0)::DOUBLE')} AS r, {_JOINT.format(f='coalesce(list_position(b, x), 0)::DOUBLE')} AS s FROM p WHERE b IS NOT NULL) "
    "SELECT pair_id, CASE WHEN len(r) = 0 THEN 1.0::DOUBLE ELSE round(1 - list_distance(r, s) / sqrt(list_sum(list_transform(list_zip(r, s), lambda z: (z[1] + z[2]) * (z[1] + z[2])))), 6) END AS sim FROM o"
)
def sent_wordorder_sim(read):
    return _turn_pairs(read).select("pair_id", r6(similarity.word_order_similarity(F.col("a"), F.col("b")), "sim"))


@query(f"{_PAIRS} SELECT pair_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) END, 6)::DOUBLE AS sim FROM p WHERE b IS NOT NULL")
def sent_jaccard(read):
    return _turn_pairs(read).select("pair_id", r6(similarity.jaccard(F.col("a"), F.col("b")), "sim"))


@query(
    f"{_PAIRS}, cw AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY 1), ic AS (SELECT word, 1 - ln(n + 1) / ln((SELECT sum(n) FROM cw) + 1) AS ic FROM cw), "
    "x AS (SELECT DISTINCT pair_id, unnest(a) AS word FROM p WHERE b IS NOT NULL), y AS (SELECT DISTINCT pair_id, unnest(b) AS word FROM p WHERE b IS NOT NULL), "
    "xx AS (SELECT pair_id, sum(ic * ic) AS v FROM x JOIN ic USING (word) GROUP BY 1), yy AS (SELECT pair_id, sum(ic * ic) AS v FROM y JOIN ic USING (word) GROUP BY 1), xy AS (SELECT pair_id, sum(ic * ic) AS v FROM x JOIN y USING (pair_id, word) JOIN ic USING (word) GROUP BY 1) "
    "SELECT pair_id, round(CASE WHEN xx.v * yy.v > 0 THEN coalesce(xy.v, 0) / sqrt(xx.v * yy.v) ELSE 0 END, 6) AS cosine FROM p LEFT JOIN xx USING (pair_id) LEFT JOIN yy USING (pair_id) LEFT JOIN xy USING (pair_id) WHERE b IS NOT NULL"
)
def sent_cosine_ic(read):
    words = read("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_LOW), F.lit(0))).alias("word"))
    return similarity.weighted_cosine(_turn_pairs(read), similarity.information_content(words)).withColumn("cosine", r6("cosine"))


_TAX = """WITH n AS (SELECT n_nationkey AS k, 'n' || n_nationkey AS id, 'r' || n_regionkey AS up, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation),
t AS (SELECT sum(c)::DOUBLE AS total FROM n), rc AS (SELECT up, sum(c) AS c FROM n GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, a.up = b.up AS kin, a.id = b.id AS same, a.c AS ca, b.c AS cb, rc.c AS cr FROM n a JOIN n b ON a.id <= b.id JOIN rc ON rc.up = a.up)"""


def _taxonomy(read):
    n, r = read("nation"), read("region")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    tree = n.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")).union(r.select(name("r", "r_regionkey"), F.lit("world")))
    counts = read("customer").groupBy(name("n", "c_nationkey").alias("node")).agg(F.count("*").alias("n"))
    ids = n.select(name("n", "n_nationkey").alias("a"))
    pairs = ids.crossJoin(F.broadcast(ids.withColumnRenamed("a", "b"))).filter("a <= b")  # concepts of a small tree
    return similarity.concept_similarity(pairs, similarity.ancestors(tree), counts)


@query(
    f"{_TAX} SELECT a, b, round(CASE WHEN same THEN 1.0 WHEN kin THEN 1 / 3.0 ELSE 1 / 5.0 END, 6)::DOUBLE AS path, round(CASE WHEN same THEN 1.0 WHEN kin THEN 4 / 6.0 ELSE 2 / 6.0 END, 6)::DOUBLE AS wup, round(-ln((CASE WHEN same THEN 1 WHEN kin THEN 3 ELSE 5 END) / 6.0), 6)::DOUBLE AS lch FROM p"
)
def taxonomy_path_wup_lch(read):
    return _taxonomy(read).select("a", "b", r6("path", "path"), r6("wup", "wup"), r6("lch", "lch"))


@query(
    f"{_TAX}, q AS (SELECT a, b, -ln(ca / total) AS ia, -ln(cb / total) AS ib, CASE WHEN same THEN -ln(ca / total) WHEN kin THEN -ln(cr / total) ELSE -ln(1.0) END AS il FROM p, t) "
    "SELECT a, b, round(abs(il), 6) AS res, CASE WHEN ia + ib > 0 THEN round(abs(2 * il / (ia + ib)), 6) END AS lin, CASE WHEN ia + ib - 2 * il > 1e-9 THEN round(1 / (ia + ib - 2 * il), 6) END AS jcn FROM q"
)
def taxonomy_res_lin_jcn(read):
    return _taxonomy(read).select("a", "b", r6(F.abs("res"), "res"), r6(F.abs("lin"), "lin"), F.when(F.col("a") != F.col("b"), r6("jcn")).alias("jcn"))


@query(
    "WITH g AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS gloss FROM benchmark), c AS (SELECT conv_id * 1000 + turn AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS context FROM conversations), "
    "m AS (SELECT id, item_id, len(list_intersect(context, gloss)) AS o, row_number() OVER (PARTITION BY id ORDER BY len(list_intersect(context, gloss)) DESC, item_id) AS r FROM c, g) SELECT id, item_id AS sense, CAST(o AS INTEGER) AS overlap FROM m WHERE r = 1"
)
def lesk_overlap(read):
    words = F.regexp_extract_all(F.lower("text"), F.lit(_LOW), F.lit(0))
    senses = read("benchmark").select(F.col("item_id").alias("sense"), words.alias("gloss"))
    contexts = read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), words.alias("context"))
    return similarity.best_overlaps(contexts, senses)


@query(
    "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), s AS (SELECT a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(a.x, b.x) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS rank FROM s) SELECT id, CAST(rank AS INTEGER) AS rank, round(c, 6) AS cosine FROM r WHERE rank <= 5"
)
def embedding_knn(read):
    rows = read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return similarity.knn(rows, 5).select("id", "rank", r6("cosine", "cosine"))


@query("SELECT round(corr(quality, n_chars), 6) AS r_chars, round(corr(quality, length(text) - length(replace(text, ' ', ''))), 6) AS r_spaces FROM labels JOIN documents USING (doc_id)")
def pearson(read):
    j = read("labels").join(read("documents"), "doc_id")
    spaces = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    return j.agg(r6(F.corr("quality", "n_chars"), "r_chars"), r6(F.corr("quality", spaces), "r_spaces"))

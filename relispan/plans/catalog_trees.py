"""Registered queries on parsed sentences: lemmas, token patterns, subjects and objects, causes; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relispan.functions import lemmas as L
from relispan.operators import entities, parse, patterns, trees
from relispan.plans.catalog import query

# ---- the parser and the lemmatiser in SQL


def _words(text: str) -> str:
    return "(" + ", ".join(f"'{w}'" for w in text.split()) + ")"


_POS = "CASE " + " ".join(f"WHEN w IN {_words(words)} THEN '{pos}'" for pos, words in parse.CLOSED.items())
_POS += " WHEN regexp_matches(w, '^[0-9]+$') THEN 'NUM' WHEN length(w) > 4 AND regexp_matches(w, '(ed|ing)$') THEN 'VERB' WHEN length(w) > 4 AND regexp_matches(w, '(ous|ful|ive|able|ible)$') THEN 'ADJ' ELSE 'NOUN' END"


def _exception(pos: str) -> str:
    return "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.exceptions(pos).items() if "'" not in a) + " END"


_STEM = "regexp_replace(w, '(ed|ing)$', '')"
_VERB = (
    "coalesce(CASE WHEN regexp_matches(w, '[^aeiou]ie[sd]$') THEN regexp_replace(w, 'ie[sd]$', 'y') END, "
    f"CASE WHEN regexp_matches(w, '(ed|ing)$') AND NOT regexp_matches(w, 'eed$') THEN CASE WHEN regexp_matches({_STEM}, '{L.NO_VOWEL}') THEN w "
    f"WHEN regexp_matches({_STEM}, '{L.DOUBLED}') THEN {_STEM}[:-2] WHEN regexp_matches({_STEM}, '(ss|ll|zz|ff)$') THEN {_STEM} WHEN regexp_matches({_STEM}, '{L.NEEDS_E}') THEN {_STEM} || 'e' ELSE {_STEM} END END, "
    "CASE WHEN regexp_matches(w, '(ss|x|z|ch|sh)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^s]s$') AND NOT regexp_matches(w, '(us|is)$') THEN regexp_replace(w, 's$', '') END, w)"
)
_NOUN = (
    "CASE WHEN regexp_matches(w, '[^aeiou]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(ss|x|z|ch|sh)es$') THEN regexp_replace(w, 'es$', '') "
    "WHEN regexp_matches(w, '[a-z]{2}s$') AND NOT regexp_matches(w, '(ss|us|is|as)$') THEN regexp_replace(w, 's$', '') ELSE w END"
)
_GUESS = f"CASE pos WHEN 'VERB' THEN coalesce({_exception('VERB')}, {_VERB}) WHEN 'NOUN' THEN coalesce({_exception('NOUN')}, {_NOUN}) WHEN 'ADJ' THEN coalesce({_exception('ADJ')}, w) WHEN 'AUX' THEN coalesce({_exception('AUX')}, w) ELSE w END"


def _rules(pos: str) -> str:
    """Stems with their places, of words w of a part of speech."""
    found = []
    for suffix, put in L.RULES[pos]:
        n = len(suffix)
        kept = f"ends_with(w, '{suffix}') AND length(w) > {n + 1}" + (" AND NOT regexp_matches(w, '(ss|us|is)$')" if suffix == "s" else "")
        stem = f"w[:-{n + 1}]"
        found.append(f"CASE WHEN {kept} THEN {stem} || '{put}' END")
        if suffix in ("ed", "ing") and not put:
            found.append(f"CASE WHEN {kept} AND regexp_matches({stem}, '{L.DOUBLED}') THEN {stem}[:-2] END")
    stems = f"list_filter([{', '.join(found)}, w], lambda x: x IS NOT NULL)"
    return f"CASE WHEN {_exception(pos)} IS NOT NULL THEN [{_exception(pos)}] ELSE {stems} END"


_SENTENCES = "sentence AS (SELECT doc_id, unnest(parts) AS text, unnest(range(len(parts)))::INTEGER AS sent FROM (SELECT conv_id * 1000 + turn AS doc_id, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\x01') AS parts FROM conversations))"


def _by_place(name: str, of: str, frame: str) -> str:
    return f"{name} OVER (PARTITION BY doc_id, sent ORDER BY i ROWS BETWEEN {frame}) AS {of}"


def _last(case: str, of: str) -> str:
    return _by_place(f"last_value(CASE WHEN {case} THEN i END IGNORE NULLS)", of, "UNBOUNDED PRECEDING AND 1 PRECEDING")


def _next(case: str, of: str, what: str = "i") -> str:
    return _by_place(f"first_value(CASE WHEN {case} THEN {what} END IGNORE NULLS)", of, "1 FOLLOWING AND UNBOUNDED FOLLOWING")


_RELATIVE = f"w IN {_words(parse.RELATIVE)}"
_GROUP = "(pos IN ('NOUN', 'NUM') AND coalesce(next_pos NOT IN ('NOUN', 'NUM'), true))"
_PARSE = f"""{_SENTENCES},
word AS (SELECT doc_id, sent, unnest(ws) AS text, lower(unnest(ws)) AS w, unnest(range(len(ws)))::INTEGER AS i FROM (SELECT doc_id, sent, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws FROM sentence)),
p0 AS (SELECT *, {_POS} AS pos FROM word),
p1 AS (SELECT *, {_GUESS} AS lemma, CASE WHEN w IN {_words(parse.MODALS)} THEN 'MD' WHEN pos = 'VERB' THEN CASE WHEN ends_with(w, 'ing') THEN 'VBG' WHEN ends_with(w, 'ed') THEN 'VBN' ELSE 'VB' END
    WHEN pos = 'NOUN' AND regexp_matches(w, '[a-z]{{3}}s$') THEN 'NNS' ELSE pos[:2] END AS tag FROM p0),
p2 AS (SELECT *, lead(pos) OVER s AS next_pos, lag(pos) OVER s AS prev_pos, lead(tag) OVER s AS next_tag, coalesce(lead({_RELATIVE}) OVER s, false) AS next_relative FROM p1 WINDOW s AS (PARTITION BY doc_id, sent ORDER BY i)),
p3 AS (SELECT *, {_GROUP} AS grp, {_last(f"{_RELATIVE} AND prev_pos IN ('NOUN', 'NUM')", "last_rel")}, {_next(f"{_RELATIVE} AND prev_pos IN ('NOUN', 'NUM')", "next_rel")}, {_last("pos = 'VERB'", "last_verb")}, {_next("pos = 'VERB'", "next_verb")},
    {_last(_GROUP, "last_group")}, {_next(_GROUP, "next_group")}, {_last("pos IN ('ADP', 'CCONJ', 'VERB', 'PRON', 'AUX', 'PART')", "link_i")},
    {_by_place("last_value(CASE WHEN pos IN ('ADP', 'CCONJ', 'VERB', 'PRON', 'AUX', 'PART') THEN pos END IGNORE NULLS)", "link", "UNBOUNDED PRECEDING AND 1 PRECEDING")} FROM p2),
p4 AS (SELECT *, pos = 'VERB' AND last_rel IS NOT NULL AND coalesce(last_verb, -1) < last_rel AS in_clause, pos = 'AUX' AND tag <> 'MD' AND next_verb IS NOT NULL AND coalesce(next_tag = 'VBN', false) AS passive_aux FROM p3),
p5 AS (SELECT *, coalesce(min(CASE WHEN pos = 'VERB' AND NOT in_clause THEN i END) OVER a, min(CASE WHEN grp THEN i END) OVER a, min(i) OVER a) AS main, coalesce(lag(passive_aux) OVER s, false) AS after_passive
    FROM p4 WINDOW a AS (PARTITION BY doc_id, sent), s AS (PARTITION BY doc_id, sent ORDER BY i)),
p6 AS (SELECT *, last_rel IS NOT NULL AND coalesce(last_verb, -1) < last_rel AND coalesce(next_rel > next_verb, true) AS inside, {_next("pos = 'VERB' AND NOT in_clause", "free_verb")}, coalesce({_next("pos = 'VERB' AND NOT in_clause", "x", "after_passive").rsplit(" AS ", 1)[0]}, false) AS free_passive, coalesce({_next("pos = 'VERB'", "x", "after_passive").rsplit(" AS ", 1)[0]}, false) AS next_passive, max(CASE WHEN i = main THEN after_passive END) OVER (PARTITION BY doc_id, sent) AS main_passive,
    greatest(last_verb, last_group) AS content, CASE WHEN pos IN ('NOUN', 'NUM') AND NOT grp THEN 1 ELSE 0 END AS inner_noun FROM p5),
p7 AS (SELECT *, CASE WHEN inside THEN next_verb ELSE free_verb END AS its_verb, CASE WHEN inside THEN next_passive ELSE free_passive END AS its_passive, CASE WHEN i = main THEN 1 WHEN inner_noun = 1 THEN 2 WHEN grp AND link = 'ADP' THEN 3 WHEN grp AND link = 'CCONJ' AND last_group IS NOT NULL THEN 4 WHEN grp AND link = 'VERB' THEN 5
    WHEN grp AND next_relative AND main > i THEN 6 WHEN grp AND NOT next_relative AND CASE WHEN inside THEN next_verb ELSE free_verb END IS NOT NULL THEN 7 WHEN grp AND last_verb IS NOT NULL THEN 8 WHEN pos = 'DET' AND next_group IS NOT NULL THEN 9 WHEN pos = 'ADJ' AND next_group IS NOT NULL THEN 10
    WHEN pos = 'ADP' AND content IS NOT NULL THEN 11 WHEN pos = 'CCONJ' AND content IS NOT NULL THEN 12 WHEN passive_aux THEN 13 WHEN pos = 'AUX' AND next_verb IS NOT NULL THEN 14 WHEN pos = 'PART' AND next_verb IS NOT NULL THEN 15
    WHEN pos = 'PRON' AND next_verb IS NOT NULL THEN 16 WHEN in_clause THEN 17 WHEN pos = 'VERB' AND tag = 'VBG' THEN 18 WHEN pos = 'VERB' THEN 19 ELSE 20 END AS rule FROM p6),
tok AS (SELECT doc_id, sent, i, text, lemma, pos, tag,
    ['ROOT', 'compound', 'pobj', 'conj', 'dobj', CASE WHEN main_passive THEN 'nsubjpass' ELSE 'nsubj' END, CASE WHEN its_passive THEN 'nsubjpass' ELSE 'nsubj' END, 'dobj', 'det', 'amod', 'prep', 'cc', 'auxpass', 'aux', 'neg',
        CASE WHEN next_passive THEN 'nsubjpass' ELSE 'nsubj' END, 'relcl', 'advcl', 'conj', 'dep'][rule] AS dep,
    [i, next_group, link_i, last_group, link_i, main, its_verb, last_verb, next_group, next_group, content, content, next_verb, next_verb, next_verb, next_verb, last_rel - 1, main, main, main][rule] AS head FROM p7)"""
#: (doc_id, sent, i, anc, up): each token with itself and all tokens above it.
_ABOVE = """above AS (SELECT doc_id, sent, i, i AS anc, 0 AS up FROM tok UNION ALL SELECT a.doc_id, a.sent, a.i, t.head, a.up + 1 FROM above a JOIN tok t ON t.doc_id = a.doc_id AND t.sent = a.sent AND t.i = a.anc WHERE t.head <> t.i),
tree AS (SELECT t.*, h.dep AS head_dep, d.depth, t.dep LIKE '%pass' AND t.dep <> 'auxpass' OR coalesce(l.aux, false) AS passive, coalesce(l.modal, false) AS modal
    FROM tok t JOIN (SELECT doc_id, sent, i, max(up) AS depth FROM above GROUP BY ALL) d USING (doc_id, sent, i) LEFT JOIN tok h ON h.doc_id = t.doc_id AND h.sent = t.sent AND h.i = t.head
    LEFT JOIN (SELECT doc_id, sent, head AS i, bool_or(dep = 'auxpass') AS aux, bool_or(dep LIKE 'aux%' AND tag = 'MD') AS modal FROM tok WHERE i < head GROUP BY ALL) l ON l.doc_id = t.doc_id AND l.sent = t.sent AND l.i = t.i)"""


def _one_of(x: str, names: list[str]) -> str:
    return f"({x}.dep IN {_words(' '.join(names))} OR {x}.dep = 'compound' AND {x}.head_dep IN {_words(' '.join(names))})"


#: Subjects and objects of all tokens: candidates below a branch, the nearest of them.
_ARGUMENTS = f"""branch AS (SELECT b.doc_id, b.sent, b.head AS parent, b.i AS branch, a.i AS x FROM tree b JOIN above a ON a.doc_id = b.doc_id AND a.sent = b.sent AND a.anc = b.i WHERE b.i <> b.head),
subject AS (SELECT doc_id, sent, i, x, text FROM (SELECT u.doc_id, u.sent, u.i, b.x, x.text, row_number() OVER (PARTITION BY u.doc_id, u.sent, u.i ORDER BY u.up, b.branch, x.depth, x.i) AS r
    FROM above u JOIN tree a ON a.doc_id = u.doc_id AND a.sent = u.sent AND a.i = u.i JOIN branch b ON b.doc_id = u.doc_id AND b.sent = u.sent AND b.parent = u.anc AND b.branch < u.anc
    JOIN tree x ON x.doc_id = u.doc_id AND x.sent = u.sent AND x.i = b.x
    WHERE CASE WHEN a.passive THEN {_one_of("x", trees.PASSIVE_SUBJECTS)} ELSE {_one_of("x", trees.SUBJECTS)} END
    AND NOT EXISTS (SELECT 1 FROM above m JOIN tree q ON q.doc_id = m.doc_id AND q.sent = m.sent AND q.i = m.anc WHERE m.doc_id = u.doc_id AND m.sent = u.sent AND m.i = u.i AND m.up < u.up AND q.passive)) WHERE r = 1),
object AS (SELECT doc_id, sent, i, x, text FROM (SELECT b.doc_id, b.sent, b.parent AS i, b.x, x.text, row_number() OVER (PARTITION BY b.doc_id, b.sent, b.parent ORDER BY b.branch, x.depth, x.i) AS r
    FROM branch b JOIN tree x ON x.doc_id = b.doc_id AND x.sent = b.sent AND x.i = b.x WHERE b.branch > b.parent AND {_one_of("x", trees.OBJECTS)}) WHERE r = 1)"""


def _sentences(read) -> DataFrame:
    docs = read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return entities.sentences(docs)


@query(
    f"WITH {_SENTENCES}, word AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS w FROM sentence), p AS (SELECT w, {_POS} AS pos FROM word), "
    f"s AS (SELECT w, pos, CASE pos WHEN 'VERB' THEN {_rules('VERB')} WHEN 'NOUN' THEN {_rules('NOUN')} WHEN 'ADJ' THEN {_rules('ADJ')} WHEN 'AUX' THEN [coalesce({_exception('AUX')}, w)] ELSE [w] END AS stems, {_GUESS} AS guess FROM p), "
    "t AS (SELECT w, pos, unnest(stems) AS stem, unnest(range(len(stems))) AS k FROM s), b AS (SELECT t.w, min_by(stem, k) AS stem FROM t JOIN word v ON v.w = t.stem GROUP BY 1) "
    "SELECT s.w AS word, s.pos, coalesce(b.stem, s.guess) AS lemma FROM s LEFT JOIN b ON b.w = s.w"
)
def lemmatised(read):
    low = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")
    words = read("conversations").select(low).distinct()
    return L.lemmas(words.select("word", parse.word_class(F.col("word")).alias("pos")), words)


#: Words of the given texts in patterns with each kind of element and operator.
PATTERNS = [
    patterns.phrase_pattern("of ? thing", "thing"),
    patterns.Pattern("group", (("LOWER", "of", ""), ("POS", "DET", "*"), ("POS", "NOUN", "+"))),
    patterns.Pattern("passive", (("LEMMA", "be", ""), ("LOWER", "not", "?"), ("POS", "VERB", ""))),
    patterns.Pattern("other", (("ORTH", "The", ""), ("POS", "NOUN", "!"), ("LOWER", "of", "")), "id1"),
    patterns.Pattern("linked", (("POS", "NOUN", ""), ("POS", "CCONJ", ""), ("POS", "DET", "?"), ("POS", "NOUN", ""))),
]


def _pattern_sql(made: list[patterns.Pattern]) -> str:
    """Threads (pattern, start, place, state) step by step: an element may be skipped or take the next token."""
    rows = []
    for n, p in enumerate(made):
        flat = patterns._expanded(p)
        rows += [f"({n}, {j}, '{a}', '{v}', '{op}', {len(flat)}, '{p.label}', {'NULL' if p.ent_id is None else repr(p.ent_id)})" for j, (a, v, op) in enumerate(flat)]
    matches = "(CASE e.attr WHEN 'LOWER' THEN lower(t.text) WHEN 'LEMMA' THEN lower(t.lemma) WHEN 'ORTH' THEN t.text ELSE t.pos END = e.value)"
    return f"""WITH RECURSIVE {_PARSE}, e(n, j, attr, value, op, m, label, ent_id) AS (VALUES {", ".join(rows)}),
thread AS (SELECT DISTINCT doc_id, sent, n, i AS start, i AS here, 0 AS j FROM tok, (SELECT DISTINCT n FROM e)
    UNION
    SELECT doc_id, sent, n, start, here + took, j + moved FROM (
        SELECT r.doc_id, r.sent, r.n, r.start, r.here, r.j, unnest([0, 1]) AS took, e.op, {matches} AS hit, unnest([1, CASE WHEN e.op = '*' THEN 0 ELSE 1 END]) AS moved
        FROM thread r JOIN e ON e.n = r.n AND e.j = r.j LEFT JOIN tok t ON t.doc_id = r.doc_id AND t.sent = r.sent AND t.i = r.here)
    WHERE CASE WHEN took = 0 THEN op IN ('?', '*') ELSE CASE WHEN op = '!' THEN NOT hit ELSE hit END END)
SELECT r.doc_id, r.sent, r.start, r.here AS "end", (SELECT string_agg(text, ' ' ORDER BY i) FROM tok t WHERE t.doc_id = r.doc_id AND t.sent = r.sent AND t.i >= r.start AND t.i < r.here) AS text, e.label, e.ent_id
FROM thread r JOIN e ON e.n = r.n AND e.j = 0 AND r.j = e.m WHERE r.here > r.start"""


@query(_pattern_sql(PATTERNS))
def pattern_matches(read):
    return patterns.match_patterns(parse.token_arrays(parse.parse(_sentences(read))), PATTERNS, ["doc_id", "sent"])


@query(
    f"WITH RECURSIVE {_PARSE}, {_ABOVE}, {_ARGUMENTS}, verb AS (SELECT * FROM tree WHERE lower(lemma) IN (SELECT lower(lemma) FROM tree WHERE pos = 'VERB')) "
    "SELECT v.doc_id, v.sent, v.i, CASE WHEN v.passive THEN o.text ELSE s.text END AS subject, v.text AS predicate, CASE WHEN v.passive THEN s.text ELSE o.text END AS object "
    "FROM verb v JOIN subject s USING (doc_id, sent, i) JOIN object o USING (doc_id, sent, i) "
    "WHERE v.depth = 0 OR NOT EXISTS (SELECT 1 FROM verb r WHERE r.doc_id = v.doc_id AND r.sent = v.sent AND r.depth = 0 AND r.pos = 'VERB')"
)
def tree_svo(read):
    t = trees.numbered(parse.parse(_sentences(read)))
    return trees.svo(t, t.filter("pos = 'VERB'"))


#: Kinds of causal keywords among the tokens of the given texts, which have no such words of their own, by their endings.
_KIND = {
    "verb": "pos = 'VERB'",
    "causal-noun": "pos = 'NOUN' AND (lemma LIKE '%tion')",
    "effect-noun": "pos = 'NOUN' AND (lemma LIKE '%ment' OR lemma LIKE '%ble')",
    "effect-relator": "pos = 'ADP' AND lemma = 'for'",
    "causal-relator": "pos = 'ADP' AND lemma = 'as'",
}
_KIND_SQL = "CASE " + " ".join(f"WHEN {case} THEN '{kind}'" for kind, case in _KIND.items()) + " END"
_ARGS, _CLAUSE = _words(" ".join(trees.ARGUMENTS)), _words(" ".join(trees.CLAUSES))
_GUESSES = ["that", "thing"]
_CAUSES = f"""{_ABOVE}, {_ARGUMENTS},
climb AS (SELECT doc_id, sent, i, i AS top FROM tok UNION ALL SELECT c.doc_id, c.sent, c.i, t.head FROM climb c JOIN tok t ON t.doc_id = c.doc_id AND t.sent = c.sent AND t.i = c.top WHERE t.dep = 'conj'),
tops AS (SELECT DISTINCT doc_id, sent, c.i AS i, top FROM climb c JOIN tok t USING (doc_id, sent) WHERE t.i = c.top AND t.dep <> 'conj'),
kinds AS (SELECT *, {_KIND_SQL} AS kind FROM tree),
ent AS (SELECT k.*, top, lag(top) OVER (PARTITION BY k.doc_id, k.sent ORDER BY k.i) AS prior FROM kinds k JOIN tops USING (doc_id, sent, i) WHERE kind IS NULL AND pos = 'NOUN' AND length(text) > 3),
grouped AS (SELECT *, max(CASE WHEN prior IS NULL OR prior <> top THEN i END) OVER (PARTITION BY doc_id, sent ORDER BY i) AS grp FROM ent),
grp AS (SELECT doc_id, sent, grp, bool_or(dep IN {_ARGS} OR coalesce(head_dep IN {_ARGS}, false)) AS valid, list({{'i': i, 'text': text}} ORDER BY i) AS ents FROM grouped GROUP BY ALL),
several AS (SELECT doc_id, sent FROM grp GROUP BY ALL HAVING count(*) > 1),
key AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY i) AS n FROM kinds SEMI JOIN several USING (doc_id, sent) WHERE kind IS NOT NULL),
stretch AS (SELECT g.*, (SELECT count(*) FROM key k WHERE k.doc_id = g.doc_id AND k.sent = g.sent AND k.i <= g.grp) AS k FROM grp g SEMI JOIN several USING (doc_id, sent) WHERE valid),
side AS (SELECT k.doc_id, k.sent, k.n, s.ents, s.grp, s.k = k.n AS right_, EXISTS (SELECT 1 FROM above a WHERE a.doc_id = k.doc_id AND a.sent = k.sent AND a.i = s.grp AND a.anc = k.i) AS own,
    EXISTS (SELECT 1 FROM above a WHERE a.doc_id = k.doc_id AND a.sent = k.sent AND a.i = s.grp AND a.anc = k.head) AS by_head FROM key k JOIN stretch s ON s.doc_id = k.doc_id AND s.sent = k.sent AND k.n IN (s.k, s.k + 1)),
lists AS (SELECT doc_id, sent, n, flatten(list(ents) FILTER (NOT right_)) AS lefts, flatten(list(ents) FILTER (right_)) AS rights, flatten(list(ents) FILTER (right_ AND own)) AS below, flatten(list(ents) FILTER (right_ AND NOT own)) AS beside
    FROM side WHERE own OR by_head GROUP BY ALL),
guess AS (SELECT DISTINCT a.doc_id, a.sent, a.anc AS i FROM above a JOIN tok t USING (doc_id, sent, i) WHERE t.lemma IN {_words(' '.join(_GUESSES))} UNION SELECT doc_id, sent, i FROM tree WHERE modal),
k1 AS (SELECT k.*, h.dep AS h_dep, l.lefts, l.rights, l.below, l.beside, [{{'i': s.x, 'text': s.text}}] AS own_s, s.x IS NOT NULL AS has_s, [{{'i': o.x, 'text': o.text}}] AS own_o, o.x IS NOT NULL AS has_o,
    CASE WHEN hs.x IS NOT NULL THEN [{{'i': hs.x, 'text': hs.text}}] END AS head_s, CASE WHEN ho.x IS NOT NULL THEN [{{'i': ho.x, 'text': ho.text}}] END AS head_o, CASE WHEN us.x IS NOT NULL THEN [{{'i': us.x, 'text': us.text}}] END AS above_s,
    g.i IS NOT NULL AS own_guess, gh.i IS NOT NULL AS head_guess
    FROM key k LEFT JOIN lists l USING (doc_id, sent, n) JOIN tree h ON h.doc_id = k.doc_id AND h.sent = k.sent AND h.i = k.head LEFT JOIN subject s ON s.doc_id = k.doc_id AND s.sent = k.sent AND s.i = k.i LEFT JOIN object o ON o.doc_id = k.doc_id AND o.sent = k.sent AND o.i = k.i
    LEFT JOIN subject hs ON hs.doc_id = k.doc_id AND hs.sent = k.sent AND hs.i = k.head LEFT JOIN object ho ON ho.doc_id = k.doc_id AND ho.sent = k.sent AND ho.i = k.head LEFT JOIN subject us ON us.doc_id = k.doc_id AND us.sent = k.sent AND us.i = h.head
    LEFT JOIN guess g ON g.doc_id = k.doc_id AND g.sent = k.sent AND g.i = k.i LEFT JOIN guess gh ON gh.doc_id = k.doc_id AND gh.sent = k.sent AND gh.i = k.head),
k2 AS (SELECT * EXCLUDE (own_s, own_o), CASE WHEN has_s THEN own_s END AS own_s, CASE WHEN has_o THEN own_o END AS own_o, kind IN ('causal-noun', 'effect-noun') AS noun, kind = 'verb' AND depth = 0 AS main,
    CASE WHEN kind = 'causal-noun' THEN 'effect-relator' ELSE 'causal-relator' END AS wanted FROM k1),
k3 AS (SELECT *, noun AND dep = 'nsubj' AND rights IS NOT NULL OR kind = 'effect-relator' AND lefts IS NULL AND rights IS NOT NULL AS alone, lead(kind) OVER w AS next_kind, lead(coalesce(rights, own_o)) OVER w AS next_rights, lead(n) OVER w AS next_n
    FROM k2 WINDOW w AS (PARTITION BY doc_id, sent ORDER BY n)),
k4 AS (SELECT *, coalesce(alone AND beside IS NULL AND next_kind = wanted, false) AS takes FROM k3),
walk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY n) AS r, (SELECT count(*) FROM k4 b WHERE b.doc_id = k4.doc_id AND b.sent = k4.sent AND b.n < k4.n AND b.takes AND NOT EXISTS (SELECT 1 FROM k4 c WHERE c.doc_id = k4.doc_id AND c.sent = k4.sent AND c.n > b.n AND c.n < k4.n AND NOT c.takes)) AS chain FROM k4),
k5 AS (SELECT *, CASE WHEN main THEN CASE WHEN passive THEN {{'c': coalesce(rights, own_o), 'e': coalesce(lefts, own_s)}} ELSE {{'c': coalesce(lefts, own_s), 'e': coalesce(rights, own_o)}} END
    WHEN noun AND dep = 'attr' AND rights IS NOT NULL THEN CASE WHEN kind = 'effect-noun' THEN {{'c': rights, 'e': coalesce(lefts, head_s)}} ELSE {{'c': coalesce(lefts, head_s), 'e': rights}} END
    WHEN alone THEN CASE WHEN kind = 'causal-noun' THEN {{'c': coalesce(beside, CASE WHEN next_kind = wanted THEN next_rights WHEN next_n IS NULL THEN head_o END), 'e': coalesce(below, own_o)}}
        ELSE {{'c': coalesce(below, own_o), 'e': coalesce(beside, CASE WHEN next_kind = wanted THEN next_rights WHEN next_n IS NULL THEN head_o END)}} END END AS stated FROM walk WHERE chain % 2 = 0 AND coalesce(lefts, rights) IS NOT NULL),
k6 AS (SELECT *, coalesce(last_value(CASE WHEN main THEN stated END IGNORE NULLS) OVER w, first_value(stated IGNORE NULLS) OVER w) AS so_far FROM k5 WINDOW w AS (PARTITION BY doc_id, sent ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k7 AS (SELECT *, CASE WHEN so_far IS NOT NULL THEN list_concat(coalesce(so_far.c, []), coalesce(so_far.e, [])) END AS known FROM k6),
k8 AS (SELECT *, CASE WHEN rights IS NOT NULL AND kind = 'verb' AND NOT main AND dep IN {_CLAUSE} THEN {{'c': coalesce(known, lefts, head_s), 'e': rights}}
    WHEN rights IS NOT NULL AND noun AND h_dep IN {_CLAUSE} THEN CASE WHEN kind = 'effect-noun' THEN {{'c': rights, 'e': coalesce(known, lefts, above_s)}} ELSE {{'c': coalesce(known, lefts, above_s), 'e': rights}} END
    WHEN stated IS NOT NULL THEN stated WHEN kind = 'effect-relator' THEN CASE WHEN lefts IS NOT NULL AND rights IS NOT NULL THEN {{'c': rights, 'e': lefts}} END WHEN kind = 'causal-relator' THEN {{'c': coalesce(lefts, known), 'e': rights}} END AS pair FROM k7)
SELECT doc_id, sent, i AS start, text AS keyword, c.text AS cause, c.i AS cause_i, e.text AS effect, e.i AS effect_i, CASE WHEN noun THEN head_guess ELSE own_guess END AS conjecture
FROM (SELECT *, unnest(pair.e) AS e FROM (SELECT *, unnest(pair.c) AS c FROM k8 WHERE pair.c IS NOT NULL AND pair.e IS NOT NULL))"""


@query(f"WITH RECURSIVE {_PARSE}, {_CAUSES}")
def tree_causes(read):
    t = trees.numbered(parse.parse(_sentences(read)))
    kinds = t.withColumn("kind", F.expr(_KIND_SQL))
    span = ["doc_id", "sent", F.col("i").alias("start"), (F.col("i") + 1).alias("end"), "text"]
    named = kinds.filter("kind IS NULL AND pos = 'NOUN' AND length(text) > 3").select(*span)
    return trees.causes(t, named, kinds.filter("kind IS NOT NULL").select(*span, "kind"), _GUESSES)


def _rules_sql() -> str:
    """Dots that end no sentence are hidden, the other candidates marked; those in brackets or quotation marks are joined."""
    either = lambda words: "|".join(w.replace(".", "\\.") for w in words.split())
    hidden = "text"
    for p, to in (
        (rf"\b({either(entities.ABBREVIATIONS)})\.", "\\1\x02"),
        (r"\b([A-Z])\.", "\\1\x02"),
        (r"(\A|\n)([ \t]{0,3})([0-9]{1,2}|[A-Za-z])\.", "\\1\\2\\3\x02"),
        (rf"\b({either(entities.NUMBERED)})\.(\s+[0-9])", "\\1\x02\\2"),
    ):
        hidden = f"regexp_replace({hidden}, '{p}', '{to}', 'g')"
    marked = f"regexp_replace({hidden}, '([.!?][\"''”’)\\]]{{0,2}}\\s+)([A-Z0-9\"''“‘(\\[])', '\\1\x01\\2', 'g')"
    near = entities.NEAR
    return f"""WITH p AS (SELECT conv_id * 1000 + turn AS doc_id, string_split(replace({marked}, '\x02', '.'), '\x01') AS parts FROM conversations),
q AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS k, parts FROM p),
r AS (SELECT doc_id, k, part, k > 0 AND NOT regexp_matches(array_to_string(parts[k + 1:], ''), '^[^()]{{0,{near}}}\\)') AND NOT regexp_matches(array_to_string(parts[k + 1:], ''), '^[^“”]{{0,{near}}}”') AS opens FROM q),
s AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY k) AS sent FROM r)
SELECT doc_id, sent::INTEGER AS sent, md5(regexp_replace(string_agg(part, '' ORDER BY k), '\\s+$', '')) AS digest FROM s GROUP BY ALL"""


@query(_rules_sql())
def sentence_rules(read):
    docs = read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    parted = entities.sentences(docs, pattern=entities.SENTENCE_BREAK)
    return parted.select("doc_id", "sent", F.md5(F.regexp_replace("text", r"\s+$", "")).alias("digest"))

"""Secret scans, by SQL functions alone.

Fixed patterns find assignments, access keys and long hexadecimal runs. Beside them, long tokens are scored by two
Markov models of neighbouring characters, one of random strings and one of ordinary identifiers: a token whose
log-likelihood ratio is large enough for its length is reported as well. Both models are counted from labelled tokens:
the values that the patterns find are random, tokens that several documents hold are ordinary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relispan.llm.blocks import set_aside

#: Kinds of base matches in order: pattern, the group whose length counts, and the least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so that shorter ones need not be matched and dropped
}
MODEL_KIND = "markov"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
TOKEN = "[A-Za-z0-9+/_-]{%d,}"
MIN_TOKEN = 20
TRAIN_TOKEN = 6
TRAIN_DOCS = 20_000  # the models are counted from about so many documents at most, chosen by a hash of their ids
PRIOR = 8.0
THRESHOLD = 0.5  # nats a character by which a token must look more random than ordinary


STEP = 64  # elements of an array that are gone through one by one; sums of so many are gone through in turn
CUT = 4096  # characters of a block of text, so that no place is counted from the start of a long one


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: int, op) -> Column:
    """What ``op`` makes of each element and all before it, for an array of bigint. ``op`` must be associative.

    Going through an array copies what it has gathered at each element, so it is done in blocks of ``STEP``, and in the
    same way with what the blocks make.
    """

    def through(x: Column, first: Column) -> Column:
        def step(acc: Column, v: Column) -> Column:
            now = op(acc["at"], v)
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

        start = F.struct(first.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(x, start, step, lambda acc: acc["out"])

    def parted(x: Column) -> Column:
        n = F.floor((F.size(x) + STEP - 1) / STEP).cast("int")
        return F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.slice(x, i * STEP + 1, F.lit(STEP)))

    def whole(x: Column, depth: int) -> Column:
        if not depth:
            return through(x, F.lit(zero))

        def joined(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero).cast("bigint"), op))
            return let(
                whole(totals, depth - 1),
                lambda ends: F.flatten(
                    F.transform(parts, lambda p, i: through(p, F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(zero).cast("bigint"))))
                ),
            )

        return let(x, lambda held: let(parted(held), joined))

    return whole(values, 2)


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Array of (start, kind, end, value) of the leftmost non-overlapping matches whose group is long enough.

    What stands between the matches tells their places: start and end (exclusive) in code points.
    """
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")

    def found(whole: Column) -> Column:
        lengths = F.zip_with(F.split(text, pattern, -1), whole, lambda gap, w: (F.length(gap) + F.coalesce(F.length(w), F.lit(0))).cast("bigint"))

        def row(w: Column, end: Column) -> Column:
            value = F.regexp_extract(w, pattern, group) if group else w
            return F.struct((end - F.length(w)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))

        ends = running(F.slice(lengths, F.lit(1), F.size(whole)), 0, lambda a, b: a + b)
        return F.filter(F.zip_with(whole, ends, row), lambda x: F.length(x["value"]) >= least)

    return F.when(F.rlike(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)).otherwise(empty)


def base_matches(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The named columns with ``__t`` (the text; null is empty) and ``__base``, an array of base matches."""
    whole = F.coalesce(text, F.lit(""))
    found = [matches(whole, p, group, least, k) for k, (p, group, least) in enumerate(BASE.values())]
    return docs.select(*columns, whole.alias("__t"), F.array_sort(F.concat(*found)).alias("__base"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of the next character given one, from rows (token, random boolean).

    The result has one number for each pair of characters of the alphabet, whatever the samples' size.
    """
    pairs = samples.select(
        "random",
        F.explode(F.expr("transform(sequence(1, greatest(1, length(token) - 1)), i -> substring(token, i, 2))")).alias("pair"),
    )
    counted = pairs.filter(F.length("pair") == 2).groupBy("random", "pair").count()
    size = len(ALPHABET)
    counts = {True: [[0.0] * size for _ in range(size)], False: [[0.0] * size for _ in range(size)]}
    for r in counted.collect():  # as many rows as there are pairs of characters, at most
        a, b = ALPHABET.find(r["pair"][0]), ALPHABET.find(r["pair"][1])
        if a >= 0 and b >= 0:
            counts[r["random"]][a][b] += r["count"]
    logs = {k: _conditional(m) for k, m in counts.items()}
    return [math.log(logs[True][a][b] / logs[False][a][b]) for a in range(size) for b in range(size)]


def _conditional(counts: list[list[float]]) -> list[list[float]]:
    """Probabilities of the next character; ``PRIOR`` counts are added as the characters are distributed on the whole."""
    size = len(counts)
    single = [1 + sum(row[b] for row in counts) for b in range(size)]
    overall = [x / sum(single) for x in single]
    return [[(row[b] + PRIOR * overall[b]) / (sum(row) + PRIOR) for b in range(size)] for row in counts]


def labelled_tokens(docs: DataFrame, id_column: str = "doc_id", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(token, random) from a bounded share of the documents: values of base matches are random; tokens that several
    documents hold, and no base match does, are ordinary. Tokens of one document have no label: they may be secrets."""
    one_in = max(1, math.ceil(docs.count() / train_docs))
    some = docs.filter(F.pmod(F.xxhash64(id_column), F.lit(one_in)) == 0)
    rows = base_matches(some.select("text"), [])
    tokens = lambda text: F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN % TRAIN_TOKEN), F.lit(0)))).alias("token")
    values = rows.select(F.explode(F.transform("__base", lambda x: x["value"])).alias("value"))
    random = values.select(F.col("value").alias("token"), F.lit(True).alias("random"))
    shared = rows.select(tokens(F.col("__t"))).groupBy("token").count().filter("count > 1").select("token")
    ordinary = shared.join(values.select(tokens(F.col("value"))).distinct(), "token", "left_anti")
    return random.unionByName(ordinary.select("token", F.lit(False).alias("random")))


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio a character of a token over the alphabet."""
    table = F.expr(f"array({','.join(f'{x!r}D' for x in model)})")
    size = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = F.zip_with(F.slice(codes, F.lit(1), F.length(token) - 1), F.slice(codes, F.lit(2), F.length(token) - 1), lambda a, b: a * size + b)
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.get(table, i)) / (F.length(token) - 1)


def scan(docs: DataFrame, columns: list[str], model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """The named columns with ``__t``, ``__base`` and ``__all``: base matches, and all matches, by start and kind.

    Of the long tokens those stay that meet no base match: in the order of starts, all base matches before end in time,
    and the next one begins late enough.
    """
    rows = base_matches(docs, columns)
    found = matches(F.col("__t"), TOKEN % MIN_TOKEN, 0, MIN_TOKEN, len(BASE))

    def merged(events: Column) -> Column:
        is_base = lambda e: e["kind"] < len(BASE)
        ends = running(F.transform(events, lambda e: F.when(is_base(e), e["end"]).otherwise(0)), 0, lambda a, b: F.greatest(a, b))
        far = 1 << 40
        begins = F.transform(F.reverse(events), lambda e: F.when(is_base(e), e["start"]).otherwise(far))
        places = F.arrays_zip(events.alias("e"), ends.alias("last"), F.reverse(running(begins, far, lambda a, b: F.least(a, b))).alias("next"))
        apart = F.filter(
            places,
            lambda x: is_base(x["e"])
            | ((x["last"] <= x["e"]["start"]) & (x["next"] >= x["e"]["end"]) & (ratio(x["e"]["value"], model) >= threshold)),
        )
        return F.transform(apart, lambda x: x["e"])

    rows = rows.withColumn("__long", found)
    both = let(F.array_sort(F.concat("__base", "__long")), merged)
    return rows.withColumn("__all", F.when(F.size("__long") > 0, both).otherwise(F.col("__base"))).drop("__long")


def _joined(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in [*BASE, MODEL_KIND]])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def _named(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """The named columns and the text, the former under names of no other use."""
    names = [f"__own{i}" for i in range(len(columns))]
    return docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], "text"), names


def secrets(docs: DataFrame, columns: list[str], model: list[float] | None = None, id_column: str = "doc_id") -> DataFrame:
    """The named columns with n_assign, n_access, n_hex, base_sha256, spans and n_markov of each whole text.

    Spans are kind:start:end by start and kind, in code points with the end exclusive. Null counts as the empty text.
    Without base matches in the sample, random strings are taken to be uniform. Repeated rows give a row each.
    """
    model = model if model is not None else train(labelled_tokens(docs, id_column))
    frame, names = _named(docs, columns)
    rows = scan(frame, names, model)
    count = lambda k: F.size(F.filter("__all", lambda x: x["kind"] == k)).cast("bigint")
    return rows.select(
        *[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)],
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(_joined("__base"), 256).alias("base_sha256"),
        _joined("__all").alias("spans"),
        count(len(BASE)).alias(f"n_{MODEL_KIND}"),
    )


def redact(docs: DataFrame, id_column: str = "doc_id", mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with each secret replaced by ``mark`` (overlapping spans by one) and n_chars made to fit.

    Texts without secrets, and null texts, stay as they are.
    """
    model = train(labelled_tokens(docs, id_column))
    frame, restore = set_aside(docs, "text")
    rows = scan(frame, frame.columns, model)

    def pieces(blocks: Column, spans: Column) -> Column:
        def cut(low: Column, high: Column) -> Column:
            """The text from ``low`` to ``high``, from the blocks that hold it."""
            first, last = F.floor(low / CUT).cast("int"), F.floor(high / CUT).cast("int")
            part = lambda k: F.substring(F.get(blocks, k), F.greatest(low - k * CUT, F.lit(0)).cast("int") + 1, (F.least(high - k * CUT, F.lit(CUT)) - F.greatest(low - k * CUT, F.lit(0))).cast("int"))
            return F.array_join(F.transform(F.sequence(first, last), lambda k: F.coalesce(part(k), F.lit(""))), "")

        def joined(ends: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0).cast("bigint"))
            kept = F.transform(spans, lambda x, i: F.when(x["start"] >= before(i), F.concat(cut(before(i), x["start"]), F.lit(mark))).otherwise(""))
            rest = cut(F.get(ends, F.size(ends) - 1), F.length("__t").cast("bigint"))
            return F.concat(F.array_join(kept, ""), rest)

        return let(running(F.transform(spans, lambda x: x["end"]), 0, lambda a, b: F.greatest(a, b)), joined)

    def blocks(text: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))

    cuts = F.flatten(F.transform(blocks(F.col("__t"), 64 * CUT), lambda b: F.filter(blocks(b, CUT), lambda x: x != "")))
    cleaned = F.when(F.size("__all") > 0, let(cuts, lambda held: pieces(held, F.col("__all")))).otherwise(F.col("text"))
    fitted = {"text": cleaned}
    if "n_chars" in docs.columns:
        own = frame.columns[docs.columns.index("n_chars")]
        fitted[own] = F.when(F.size("__all") > 0, F.length(cleaned).cast("bigint")).otherwise(F.col(own))
    return restore(rows.select(*[fitted.get(c, F.col(c)).alias(c) for c in frame.columns]))


def query(spark, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])

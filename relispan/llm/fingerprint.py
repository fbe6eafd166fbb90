"""Canonical exact fingerprints, by SQL functions alone.

A text's canonical form is compatibility-composed, case-folded, composed again, with each run of white space made one
space and none at the ends. Its fingerprint is two 64-bit xxHash values of that form. Texts of one fingerprint are
grouped by the canonical form itself, so that bytes are compared and a collision parts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relispan.llm.ranks import ranked
from relispan.plans.shared import shared_table

BUCKET_ROWS = 1000
RANGES = 512  # ranges of ids that are part of the plan, whatever their number; each is parted into as many buckets as it needs
BROADCAST_ROWS = 200_000  # digests, or bounds of buckets: some 25 MB


def _icu(cls: str, method: str, text: Column) -> Column:
    return F.java_method(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    composed = _icu("text.Normalizer", "compose", whole)
    folded = _icu("text.Normalizer", "compose", _icu("lang.UCharacter", "foldCase", composed))
    return F.trim(F.regexp_replace(folded, r"[\s\x{85}\p{Z}]+", " "))


def digest(form: Column) -> Column:
    """32 hexadecimal digits for a canonical form."""
    both = (F.xxhash64(form), F.xxhash64(F.lit(1), form))
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in both]))


def _ranges(keys: DataFrame, bucket_rows: int) -> tuple[list[int], list[int], int]:
    """The first key of each of ``RANGES`` ranges at most, the buckets that each is parted into, by its rows, and the
    largest key."""
    at = [i / RANGES for i in range(RANGES)]
    n, least, most, found = keys.agg(F.count("*"), F.min("__k"), F.max("__k"), F.percentile_approx("__k", at, 10 * RANGES)).first()
    if not n:
        return [0], [1], 0
    found = [least, *found]
    often = {b for a, b in zip(found, found[1:], strict=False) if a == b}  # an id that fills a range has one of its own
    lows = sorted({*found, *(b + 1 for b in often if b < (1 << 63) - 1)})
    each = max(1, round(n / RANGES / bucket_rows))
    return lows, [each * max(1, found.count(low)) for low in lows], most


def _buckets(docs: DataFrame, id_column: str, bucket_rows: int) -> DataFrame:
    """(__id, text, __k, __h, __b): rows with their bucket of neighbours by (__k, __h), about ``bucket_rows`` in each.

    Buckets cut by place have over four times the rows where ids are clumped, lie far out or repeat: their rows, without
    texts, are then ranked, and cut by rank. Rows of one id and one hash stay together.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("__id"), text.alias("text"), F.coalesce(F.col(id_column), F.lit(-(1 << 63))).alias("__k"), F.xxhash64(text).alias("__h")
    )
    lows, parts, most = _ranges(rows.select("__k"), bucket_rows)
    highs = [*lows[1:], min(most, (1 << 63) - 2) + 1]
    longs = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    halves = [1 << i for i in reversed(range(max(1, len(lows) - 1).bit_length()))]
    ahead = lambda at, step: F.coalesce(F.get(longs(lows), (at + step).cast("int")) <= F.col("__k"), F.lit(False))
    found = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at))
    rows = rows.withColumn("__r", found)
    low, high, part = (F.get(longs(x), F.col("__r")) for x in (lows, highs, parts))
    span = F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0))
    by_hash = (F.col("__h").cast("double") + 2.0**63) / 2.0**64
    share = F.when(high - 1 > low, (F.col("__k").cast("double") - low.cast("double")) / span).otherwise(by_hash)
    within = F.least(F.floor(share * part), part - 1)
    rows = rows.withColumn("__w", F.col("__r").cast("bigint") * (1 << 44) + within).drop("__r")
    large = shared_table(rows.groupBy("__w").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * bucket_rows).select("__w"), "large")
    n = large.count()
    if not n:
        return rows.select("__id", "text", "__k", "__h", F.struct("__w", F.lit(0).cast("bigint").alias("s")).alias("__b"))
    side = F.broadcast(large) if n <= BROADCAST_ROWS else large
    places = ranked(rows.select("__w", "__k", "__h").join(side, "__w"), "__w", ["__k", "__h"])
    cut = shared_table(places.groupBy("__k", "__h").agg(F.floor(F.min("rank") / bucket_rows).alias("s")), "cuts")
    calm = rows.join(side, "__w", "left_anti").withColumn("s", F.lit(0).cast("bigint"))
    both = calm.unionByName(rows.join(side, "__w").join(cut, ["__k", "__h"]).select(calm.columns))
    return both.select("__id", "text", "__k", "__h", F.struct("__w", "s").alias("__b"))


def with_next(docs: DataFrame, id_column: str = "doc_id", bucket_rows: int | None = None) -> DataFrame:
    """(id, text, next_text, fingerprint, next_fingerprint) in which the next document is that of the next larger id;
    after the last comes the first.

    Null ids come before all others; rows of one id follow each other by the hash of their texts, then by these. Rows
    are dealt to buckets of neighbours: by ranges of ids that the search in a table of fixed size finds, within a range by
    the place of the id, or of the hash where one id fills the range, and by rank where that leaves many together. The
    first rows of each bucket are also put at the end of the bucket before, so that no order over all rows in one place is
    needed.
    """
    rows = _buckets(docs, id_column, bucket_rows or BUCKET_ROWS)
    firsts = rows.groupBy("__b").agg(F.min(F.struct("__k", "__h")).alias("__head"))  # a short row a bucket
    firsts = shared_table(ranked(firsts.withColumn("__one", F.lit(0)), "__one", ["__b"]).drop("__one"), "firsts")
    behind = firsts.select(F.col("__b").alias("__before"), F.pmod(F.col("rank") + 1, F.col("n")).alias("rank"))
    firsts = firsts.join(behind, "rank").select("__b", "__head", "__before")
    firsts = shared_table(firsts, "buckets")
    side = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    # the call of ICU is worked out wherever it is named, so that it stands in a column of its own
    rows = rows.withColumn("__form", canonical(F.col("text"))).withColumn("fingerprint", digest(F.col("__form"))).drop("__form")
    joined = rows.join(side, "__b")
    is_first = F.struct("__k", "__h") == F.col("__head")
    own = F.struct(F.col("__b").alias("b"), F.lit(False).alias("copy"))
    before = F.struct(F.col("__before").alias("b"), F.lit(True).alias("copy"))
    dealt = joined.withColumn("__at", F.explode(F.when(is_first, F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select("__id", "text", "fingerprint", "__k", "__h", F.col("__at.b").alias("__bucket"), F.col("__at.copy").alias("__copy"))
    order = Window.partitionBy("__bucket").orderBy("__copy", "__k", "__h", "text")
    following = {f"next_{c}": F.lead(c).over(order) for c in ("text", "fingerprint")}  # one window, so that texts move once
    return dealt.withColumns(following).filter("NOT __copy").select(F.col("__id").alias(id_column), "text", "next_text", "fingerprint", "next_fingerprint")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by as many, or all, from the start of another text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def groups(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(fingerprint, form, group_id, n_copies): one row for each canonical form; ``group_id`` is the smallest id.

    Rows of equal digests are counted first, in the tasks that read them; the forms of digests with several rows, and of
    no others, are then grouped by their bytes. ``form`` is null where one form alone has the digest. The repeated
    digests are broadcast if there are ``BROADCAST_ROWS`` of them at most, else joined by a shuffle.
    """
    forms = docs.select(F.col(id_column).alias("__id"), canonical(F.col("text")).alias("form"))
    forms = forms.select("__id", "form", digest(F.col("form")).alias("fingerprint"))
    made = [F.min("__id").alias("group_id"), F.count("*").alias("n_copies")]
    counted = shared_table(forms.groupBy("fingerprint").agg(*made), "digests")
    several = counted.filter("n_copies > 1").select("fingerprint")
    side = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    inside = shared_table(forms.join(side, "fingerprint", "left_semi").groupBy("fingerprint", "form").agg(*made), "forms")
    clashes = inside.groupBy("fingerprint").agg(F.count("*").alias("forms")).filter("forms > 1").select("fingerprint", F.lit(True).alias("clash"))
    parted = inside.join(clashes, "fingerprint", "left").select("fingerprint", F.when(F.col("clash"), F.col("form")).alias("form"), "group_id", "n_copies")
    alone = counted.filter("n_copies = 1").select("fingerprint", F.lit(None).cast("string").alias("form"), "group_id", "n_copies")
    return alone.unionByName(parted)


def fingerprints(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id,
    n_copies.

    Likeness of an exact digest is 1 where the canonical forms are equal byte by byte and 0 elsewhere; bytes are compared
    where digests are equal. Null texts are empty texts. Rows with a null id are first in order; repeated rows are each
    other's next. A single document is its own next. An empty table gives an empty result.
    """
    pairs = with_next(docs, id_column).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    pairs = pairs.withColumn("__form", canonical(F.col("edited"))).withColumn("edited_fingerprint", digest(F.col("__form")))
    same_next = (canonical(F.col("text")) == canonical(F.col("next_text"))).cast("double")
    each = pairs.select(
        F.col(id_column).alias("__id"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        F.when(F.col("fingerprint") == F.col("edited_fingerprint"), (canonical(F.col("text")) == F.col("__form")).cast("double")).otherwise(0.0).alias("near_edited"),
        F.when(F.col("fingerprint") == F.col("next_fingerprint"), same_next).otherwise(0.0).alias("near_next"),
        "text",
    )
    known = shared_table(groups(docs, id_column), "groups")
    if known.filter("form IS NOT NULL").limit(1).count():  # several forms of one digest: bytes decide
        plain = known.filter("form IS NULL").drop("form")
        clash = known.filter("form IS NOT NULL").withColumnRenamed("fingerprint", "__f")
        formed = each.withColumn("__form", canonical(F.col("text")))
        parted = formed.join(clash, (F.col("fingerprint") == F.col("__f")) & (F.col("__form") == F.col("form"))).drop("__f", "form", "__form")
        joined = each.join(plain, "fingerprint").select(parted.columns).unionByName(parted)
    else:
        joined = each.drop("text").join(known.drop("form"), "fingerprint")
    return joined.select(
        F.col("__id").alias(id_column), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id", "n_copies"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""The registered query on quantities, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from relispan.functions import quantities as Q
from relispan.plans.catalog import query

_UNITS = ", ".join(f"('{u}', {f!r}::DOUBLE, {list(e)})" for u, (f, e) in Q.units().items())
_NAMES = ", ".join(f"({list(e)}, '{n}')" for e, n in Q.NAMES.items())


@query(
    f"WITH u(symbol, f, e) AS (VALUES {_UNITS}), names(e, name) AS (VALUES {_NAMES}), m AS (SELECT doc_id, unnest(ms) AS mention, unnest(range(len(ms)))::INTEGER AS k FROM (SELECT doc_id, regexp_extract_all(text, '{Q.QUANTITY}', 1) AS ms FROM documents)), "
    f"s AS (SELECT *, regexp_extract(mention, '^[+-]?{Q.NUMBER}') AS number FROM m), n AS (SELECT *, trim(mention[len(number) + 1:]) AS unit FROM s), "
    f"p AS (SELECT doc_id, k, unnest(regexp_extract_all(unit, '{Q.PART}', 1)) AS o, unnest(regexp_extract_all(unit, '{Q.PART}', 2)) AS symbol, unnest(regexp_extract_all(unit, '{Q.PART}', 3)) AS p, unnest(regexp_extract_all(unit, '{Q.PART}', 4)) AS q FROM n), "
    "x AS (SELECT doc_id, k, f, e, (CASE WHEN p <> '' THEN p::INTEGER WHEN q = '²' THEN 2 WHEN q = '³' THEN 3 ELSE 1 END) * (CASE WHEN o = '/' THEN -1 ELSE 1 END) AS power FROM p JOIN u USING (symbol)), "
    "t AS (SELECT doc_id, k, product(pow(f, power)) AS f, [sum(e[1] * power)::INTEGER, sum(e[2] * power)::INTEGER, sum(e[3] * power)::INTEGER, sum(e[4] * power)::INTEGER, sum(e[5] * power)::INTEGER, sum(e[6] * power)::INTEGER] AS e FROM x GROUP BY ALL) "
    "SELECT doc_id, k, mention, unit, names.name AS dimension, round(replace(number, ',', '')::DOUBLE * f, 4) AS si FROM n JOIN t USING (doc_id, k) LEFT JOIN names ON names.e = t.e"
)
def quantities(read):
    found = read("documents").select("doc_id", F.posexplode(Q.mentions(F.col("text"))).alias("k", "mention"))
    found = found.withColumn("q", Q.quantity(F.col("mention")))
    return found.select("doc_id", "k", "mention", "q.unit", "q.dimension", F.round("q.si", 4).alias("si"))

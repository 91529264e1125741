"""SpotSigs document fingerprints, in DataFrame functions only.

Every common word (anchor) starts a chain of the CHAIN content words after it; anchor and chain are
a signature. A document's fingerprint stands for its set of signatures. Documents are compared by
the Jaccard likeness of these sets. similar_pairs finds all pairs above a threshold: equal sets are one
class, sets are dealt by length, so that only lengths that allow the threshold meet, and joined on
their rarest members, of which similar sets must share one.

Words are runs of ASCII letters, digits and characters above ASCII, A-Z lowered. A text with too
few words for any signature has one signature, all its words; a text without words has none.

Defined results: a null text is empty; two empty sets have likeness 1, an empty and another set 0;
the next document is that with the next larger (doc_id, text), null ids first, after the last the
first, so repeated rows and ties have an order; extra columns are not read; an empty table gives an
empty result; very long texts are taken whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = 2
#: Common words of the corpus's languages, the anchors (fixed values).
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with not have has "
    "le la les un une des de du et est en que qui pas pour dans sur au aux avec "
    "der die das und ist von zu den dem ein eine mit auf nicht sich "
    "el los las y es por para con una se del al lo como"
).split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of one bucket of neighbouring ids, about, while there are few; buckets of a cell between two cuts, at most.
BUCKET_ROWS = 128
CELLS = 1000
#: Buckets that one task takes, about: they are dealt by hash, and many of them make tasks even.
TASK_BUCKETS = 40


def _words(text: Column) -> Column:
    """' w1 w2 ... wn ' in lower case."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, UPPER, LOWER), F.lit(" ")), _GAP, " ")


def _units(text: Column) -> Column:
    """Content words, each with the anchors before it: 'of~the~house'. Anchors at the end stay alone."""
    glued = F.regexp_replace(_words(text), f"(?<= )({'|'.join(ANCHORS)}) ", "$1~")
    return F.filter(F.split(glued, " "), lambda x: x != "")


def _signatures(units: Column) -> Column:
    """Distinct signature strings, sorted; units must be a column, not an expression."""
    content = lambda x: F.substring_index(x, "~", -1)

    def of(x: Column, i: Column) -> Column:
        # the unit's last part is its content word; an anchor at the text's end has none
        chain = F.concat_ws(" ", content(x), *[content(F.get(units, i + k)) for k in range(1, CHAIN)])
        parts = F.split(x, "~")
        anchors = F.slice(parts, F.lit(1), F.size(parts) - 1)
        whole = (content(x) != "") & F.get(units, i + CHAIN - 1).isNotNull()
        for k in range(1, CHAIN):
            whole = whole & (content(F.get(units, i + k)) != "")
        return F.when(whole & F.contains(x, F.lit("~")), F.transform(anchors, lambda a: F.concat(a, F.lit(" "), chain)))

    found = F.flatten(F.filter(F.transform(units, of), lambda x: x.isNotNull()))
    return F.array_sort(F.array_distinct(found))


def sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds name_h, the set of hashed signatures, and name_fp, the fingerprint string."""
    u, s, w = f"_{name}_u", f"_{name}_s", f"_{name}_w"
    df = df.withColumn(u, _units(F.col(text))).withColumn(s, _signatures(F.col(u)))
    alone = F.concat_ws(" ", F.flatten(F.transform(u, lambda x: F.filter(F.split(x, "~"), lambda y: y != ""))))
    df = df.withColumn(w, F.when(F.size(s) > 0, F.col(s)).when(F.size(u) > 0, F.array(alone)).otherwise(F.array().cast("array<string>")))
    return df.withColumns({f"{name}_h": F.transform(w, lambda x: F.xxhash64(x)), f"{name}_fp": F.concat(F.size(w).cast("string"), F.lit("-"), F.md5(F.array_join(w, "\n").cast("binary")))}).drop(u, s, w)


def likeness(a: str, b: str) -> Column:
    """Jaccard of two sets of distinct hashes; 1 for two empty ones, and an empty and another set are not intersected."""
    both = F.size(F.array_intersect(a, b))
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).when(F.least(F.size(a), F.size(b)) == 0, 0.0).otherwise(both / (n - both))


def classes(sets: DataFrame) -> DataFrame:
    """(h, id): every different non-empty set, sorted, and the smallest id that has it. sets: (id, h)."""
    return sets.filter(F.size("h") > 0).select("id", F.array_sort(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.min("id").alias("id"))


def memberships(sets: DataFrame) -> DataFrame:
    """(id, class_id): each non-empty set's class."""
    own = sets.filter(F.size("h") > 0).select("id", F.array_sort(F.array_distinct("h")).alias("h"))
    return own.join(classes(sets).withColumnRenamed("id", "class_id"), "h").select("id", "class_id")


def similar_pairs(sets: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(a, b, likeness) of the pairs of classes at or above the threshold. sets: (id, h).

    Length class k holds sizes in [r^k, r^(k+1)), r = 1 / threshold; a set meets its own length class and
    the next one. Members are ordered by how few sets hold them: similar sets share one of their first
    n - ceil(t n) + 1, so a passage that many texts share is not what they meet by unless they hold little else.
    """
    base = classes(sets).withColumn("n", F.size("h"))
    single = base.select("id", F.explode("h").alias("sig"))
    held = single.groupBy("sig").agg(F.count("*").alias("c"))
    rare = single.join(held, "sig").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "sig"))), lambda x: x["sig"]).alias("o"))
    part = F.floor(F.log(F.size("o").cast("double")) / math.log(1 / threshold) + 1e-9)
    first = F.slice("o", F.lit(1), (F.size("o") - F.ceil(F.lit(threshold) * F.size("o") - 1e-9) + 1).cast("int"))
    keyed = rare.select("id", F.size("o").alias("n"), part.alias("part"), F.explode(first).alias("sig"))
    shorter = keyed.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "sig")
    longer = keyed.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "part", "sig")
    fits = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    pairs = shorter.join(longer, ["part", "sig"]).filter(fits & (F.col("n_a") >= threshold * F.col("n_b"))).select("a", "b").distinct()
    full = pairs.join(base.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(base.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    return full.select("a", "b", likeness("ha", "hb").alias("likeness")).filter(F.col("likeness") >= threshold)


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (doc_id, text) dealt by neighbouring ids, each bucket with the first row of the next; see fingerprint_edits.

    There are at most 201 * CELLS buckets, whose heads the driver orders. Beyond some 25 million rows buckets grow with
    the table; a bucket is sorted and read through, never held. Rows of one id lie in one bucket.
    """
    stat = docs.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / 200 for i in range(201)], 2000).alias("cut")).first()
    cuts = sorted(set(stat.cut or [0]))
    # a cell of ids between two cuts, then CELLS equal steps inside it; null ids come first
    lows = F.array(*[F.lit(x).cast("long") for x in cuts])
    cell = F.greatest(F.lit(1), F.size(F.filter(lows, lambda c: c <= F.col("doc_id"))))
    steps = min(CELLS, max(1, stat.n // max(1, len(cuts) * BUCKET_ROWS)))
    low, high = F.element_at(lows, F.col("_cell")), F.coalesce(F.get(lows, F.col("_cell")), F.lit(cuts[-1] + 1))
    step = F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor((F.col("doc_id") - low) * F.lit(float(steps)) / F.greatest(F.lit(1), high - low))))
    rows = docs.withColumn("_cell", cell).withColumn("_bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("_cell") * steps + step).cast("long")).drop("_cell")
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "_bucket")
    # each bucket also gets the first row of the bucket after it; the last one gets the very first
    heads = rows.groupBy("_bucket").agg(F.min("doc_id").alias("_head"), F.count("*").alias("_n"))
    known = [r._bucket for r in heads.select("_bucket").orderBy("_bucket").collect()]
    if not known:
        return rows.drop("_bucket").withColumn("next_text", F.col("text")), 0
    before = docs.sparkSession.createDataFrame([(b, known[i - 1]) for i, b in enumerate(known)], "_bucket long, _to long")
    # one row a bucket: at most 201 * CELLS + 1 rows of three numbers
    first = F.broadcast(heads.join(before, "_bucket").select("_bucket", "_head", "_to"))
    ghosts = rows.join(first, "_bucket").filter(F.col("doc_id").eqNullSafe(F.col("_head"))).groupBy("_to").agg(F.min("text").alias("text"))
    ghosts = ghosts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("_to").alias("_bucket"), F.lit(1).alias("_ghost"))
    return rows.withColumn("_ghost", F.lit(0)).unionByName(ghosts), len(known)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The digest of every document, its edited text and the next document."""
    dealt, buckets = with_next(docs.select("doc_id", "text"))
    if not buckets:
        return _digest(sketch(sketch(dealt, "text", "own"), "next_text", "next"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // TASK_BUCKETS)
    own = sketch(dealt.repartition(parts, "_bucket"), "text", "own")
    w = Window.partitionBy("_bucket").orderBy("_ghost", "doc_id", "text")
    led = own.withColumns({"next_text": F.lead("text").over(w), "next_h": F.lead("own_h").over(w)}).filter("_ghost = 0")
    return _digest(led)


def _digest(df: DataFrame) -> DataFrame:
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))
    df = sketch(df.withColumn("edited", edited), "edited", "ed")
    return df.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("own_fp").alias("fingerprint"), F.col("ed_fp").alias("edited_fingerprint"),
        likeness("own_h", "ed_h").alias("near_edited"), likeness("own_h", "next_h").alias("near_next"),
    )


def oracle(anchors: list[str] = ANCHORS) -> str:
    """The same digest in DuckDB SQL, from words as rows."""
    stops = ", ".join(f"'{a}'" for a in anchors)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, count(*) OVER () AS m FROM documents),
p AS (SELECT a.doc_id, a.r, a.text, b.text AS nt, b.r AS nr, length(a.text) AS n, length(a.text) // 4 AS k FROM d a JOIN d b ON b.r = a.r % a.m + 1),
t AS (SELECT r, 0 AS e, text FROM p UNION ALL SELECT r, 1, text[1:n - k] || nt[1:k] FROM p),
w AS (SELECT r, e, list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM t),
u AS (SELECT r, e, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
c AS (SELECT *, x IN ({stops}) AS stop, count(*) FILTER (x NOT IN ({stops})) OVER (PARTITION BY r, e ORDER BY i) AS cn FROM u),
s AS (SELECT DISTINCT a.r, a.e, a.x || ' ' || b.x || ' ' || f.x AS sig FROM c a JOIN c b ON a.r = b.r AND a.e = b.e AND NOT b.stop AND b.cn = a.cn + 1
      JOIN c f ON a.r = f.r AND a.e = f.e AND NOT f.stop AND f.cn = a.cn + 2 WHERE a.stop),
g AS (SELECT w.r, w.e, CASE WHEN count(s.sig) > 0 THEN list_sort(list(s.sig)) WHEN len(any_value(w.ws)) > 0 THEN [array_to_string(any_value(w.ws), ' ')] ELSE [] END AS sigs
      FROM w LEFT JOIN s ON w.r = s.r AND w.e = s.e GROUP BY w.r, w.e),
j AS (SELECT p.*, o.sigs AS o, x.sigs AS x, y.sigs AS y FROM p JOIN g o ON o.r = p.r AND o.e = 0 JOIN g x ON x.r = p.r AND x.e = 1 JOIN g y ON y.r = p.nr AND y.e = 0)
SELECT doc_id, n AS n_chars, sha256(text[1:n - k] || nt[1:k]) AS edited_sha256, len(o) || '-' || md5(array_to_string(o, chr(10))) AS fingerprint,
  len(x) || '-' || md5(array_to_string(x, chr(10))) AS edited_fingerprint,
  CASE WHEN len(o) + len(x) = 0 THEN 1.0 WHEN least(len(o), len(x)) = 0 THEN 0.0 ELSE len(list_intersect(o, x))::DOUBLE / (len(o) + len(x) - len(list_intersect(o, x))) END AS near_edited,
  CASE WHEN len(o) + len(y) = 0 THEN 1.0 WHEN least(len(o), len(y)) = 0 THEN 0.0 ELSE len(list_intersect(o, y))::DOUBLE / (len(o) + len(y) - len(list_intersect(o, y))) END AS near_next
FROM j"""



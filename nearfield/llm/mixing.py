"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame and SQL functions only.

Each source has a target in words. A document of the source should be taken ``target / source_size``
times, which is an integer part for all and the same fraction for each. Pivotal rounding settles the
fractions: two documents meet, and words move between them until one fraction is 0 or 1; the direction
is drawn so that each document keeps its expected number of copies. The sum of words never changes, so
the words a source gives differ from its target by less than its one last document.

The meetings run as a reduction tree. Documents of a source are dealt by a hash into blocks of about
:data:`BLOCK` rows; each block is folded, from its largest document to its smallest, and leaves one
residual; the residuals are dealt and folded again until each source has one.

Defined cases. A null or empty text has size 0 and is taken 0 times. A null source is a source of its own,
last in the order. An empty table gives an empty result. doc_id and size decide every draw, so reruns
agree; rows that repeat a doc_id, and those with a null one, are rounded one by one. Other columns are neither read nor returned.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.session import materialise
from nearfield.tables import fresh

#: Rows that one fold takes, about; a shuffle group is no larger whatever the size of a source.
BLOCK = 256
#: Weights of the sources in code point order, repeated.
WEIGHTS = (3, 1, 2)
#: Words of the mix against all words, and the most that a source or document may give against its own.
SHARE, MOST = 1.5, 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _placed(sources: DataFrame) -> DataFrame:
    """sources with ``place``, a source's number from 0 in code point order, null last. Ranges are numbered apart and their sizes, few, are added up."""
    spark = sources.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    dealt = materialise(sources.repartitionByRange(ranges, order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    counts = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}  # at most one row a partition
    before = [0, *accumulate(counts.get(i, 0) for i in range(max(counts, default=0)))]
    first = F.element_at(F.array(*map(F.lit, before)).cast("array<long>"), F.col("range") + 1)
    return dealt.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1 + first).drop("range")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target) from (source, size).

    A source's share by weight stops at ``most`` times its size and the excess is dealt again by weight: all that stay below their cap
    get one level times their weight. The level rises from round to round, each a sum over the sources, until it passes no further cap.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = materialise(_placed(s).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))), "mix-weighed")
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    level, passed = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        n, capped, free = s.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n <= passed or not free:
            break
        level, passed = max(level, (share * total - capped) / free), n
    target = F.least("cap", F.col("weight") * F.lit(level)) if free else F.col("cap")
    return s.select("source", "source_size", "n", target.alias("target"))


#: One meeting: s.cur is the document whose fraction is open, b the next, t the words that can move to s.cur and from it.
_STEP = """
  CASE WHEN s.cur.p <= 0 OR s.cur.p >= 1 THEN named_struct('cur', b, 'out', concat(s.out, array(s.cur)))
  ELSE transform(array(named_struct(
         'gain', least(s.cur.size * (1 - s.cur.p), b.size * b.p),
         'lose', least(s.cur.size * s.cur.p, b.size * (1 - b.p)))), t ->
    CASE
      WHEN b.u * (t.gain + t.lose) < t.lose THEN
        CASE WHEN s.cur.size * (1 - s.cur.p) <= b.size * b.p
          THEN named_struct('cur', named_struct('size', b.size, 'doc_id', b.doc_id, 'whole', b.whole, 'u', b.u, 'p', greatest(0D, b.p - t.gain / b.size)),
                            'out', concat(s.out, array(named_struct('size', s.cur.size, 'doc_id', s.cur.doc_id, 'whole', s.cur.whole, 'u', s.cur.u, 'p', 1D))))
          ELSE named_struct('cur', named_struct('size', s.cur.size, 'doc_id', s.cur.doc_id, 'whole', s.cur.whole, 'u', s.cur.u, 'p', least(1D, s.cur.p + t.gain / s.cur.size)),
                            'out', concat(s.out, array(named_struct('size', b.size, 'doc_id', b.doc_id, 'whole', b.whole, 'u', b.u, 'p', 0D)))) END
      ELSE
        CASE WHEN s.cur.size * s.cur.p <= b.size * (1 - b.p)
          THEN named_struct('cur', named_struct('size', b.size, 'doc_id', b.doc_id, 'whole', b.whole, 'u', b.u, 'p', least(1D, b.p + t.lose / b.size)),
                            'out', concat(s.out, array(named_struct('size', s.cur.size, 'doc_id', s.cur.doc_id, 'whole', s.cur.whole, 'u', s.cur.u, 'p', 0D))))
          ELSE named_struct('cur', named_struct('size', s.cur.size, 'doc_id', s.cur.doc_id, 'whole', s.cur.whole, 'u', s.cur.u, 'p', greatest(0D, s.cur.p - t.lose / s.cur.size)),
                            'out', concat(s.out, array(named_struct('size', b.size, 'doc_id', b.doc_id, 'whole', b.whole, 'u', b.u, 'p', 1D)))) END
    END)[0]
  END
"""

_FOLD = f"""
  aggregate(slice(items, 2, size(items)),
    named_struct('cur', items[0], 'out', slice(items, 1, 0)),
    (s, b) -> {_STEP},
    s -> concat(s.out, array(s.cur)))
"""


def _uniform(*salt) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("size"), *[F.lit(x) for x in salt]), 11) / F.lit(float(1 << 53))


def _fold(items: DataFrame, blocks: Column, level: int, seed: int) -> DataFrame:
    """A level of the tree: (source, size, doc_id, whole, p, open), open for the block's last document if its fraction is."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed), F.lit(level)), blocks))
    item = F.struct("size", "doc_id", "whole", _uniform(seed, level, "draw").alias("u"), F.col("p").cast("double").alias("p"))
    folded = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(item), asc=False).alias("items")).withColumn("items", F.expr(_FOLD))
    return folded.select("source", F.explode("items").alias("i")).select("source", "i.size", "i.doc_id", "i.whole", "i.p", ((F.col("i.p") > 0) & (F.col("i.p") < 1)).alias("open"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row for each row of docs."""
    sizes = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    targets = materialise(source_targets(sizes, weights, share, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.select(F.col("source").alias("of"), "n", rate.alias("rate"))
    due = sizes.join(t, F.col("source").eqNullSafe(F.col("of")))
    due = due.withColumn("whole", F.when(F.col("size") > 0, F.floor("rate")).otherwise(F.lit(0)).cast("long")).withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(F.lit(0.0)))
    done = [due.where("p <= 0").select("source", "size", "doc_id", "whole", "p")]
    left, level = due.where("p > 0").select("source", "size", "doc_id", "whole", "p", "n"), 0
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")
    most_rows = targets.agg(F.max("n")).first()[0] or 0
    while True:
        folded = materialise(_fold(left, blocks, level, seed), f"mix-level{level}")
        done.append(folded.where("NOT open").drop("open"))
        most_rows = -(-most_rows // BLOCK)
        if most_rows <= 1:
            break
        level += 1
        left = folded.where("open").drop("open").join(t.select("of", "n"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        blocks = F.ceil(F.col("n") / F.lit(float(BLOCK ** (level + 1)))).cast("long")
    last = folded.where("open").drop("open").withColumn("p", F.when(_uniform(seed, "last") < F.col("p"), F.lit(1.0)).otherwise(F.lit(0.0)))
    out = last
    for part in done:
        out = out.unionByName(part)
    out = out.withColumn("copies", F.col("whole") + F.round("p").cast("long"))
    info = targets.select(F.col("source").alias("of"), "source_size", "target")
    return out.join(info, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs.

    A source whose documents are all taken equally often says so for all; only documents of the others look up their own number,
    by doc_id and source, null or not. Rows that repeat both are matched by their size, and by their place among equal sizes.
    """
    low, high, given, copies, rows, ident, of, size, words, place, row = fresh(docs, "_low", "_high", "_given", "_copies", "_rows", "_id", "_of", "_size", "_words", "_place", "_row")
    own_id, own_source = F.col(id_col), F.col(source_col).cast("string")
    mixed = materialise(mix(docs, id_col, text_col, source_col, **options), "mix-taken").where("size > 0")
    by_source = mixed.groupBy("source").agg(F.min("copies").alias(low), F.max("copies").alias(high)).withColumnRenamed("source", given)
    by_source = materialise(by_source, "mix-sources")
    uneven = by_source.where(F.col(low) < F.col(high)).select(given)
    own = mixed.join(uneven, F.col("source").eqNullSafe(F.col(given)), "left_semi")
    own = own.groupBy(F.col("doc_id").alias(ident), F.col("source").alias(of)).agg(F.max("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    own = materialise(own, "mix-own")
    this = own_id.eqNullSafe(F.col(ident)) & own_source.eqNullSafe(F.col(of))
    repeats = own.where(F.col(rows) > 1).select(ident, of)
    numbered = mixed.join(repeats, F.col("doc_id").eqNullSafe(F.col(ident)) & F.col("source").eqNullSafe(F.col(of)), "left_semi")
    order = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.desc("copies")))
    numbered = numbered.select(F.col("doc_id").alias(ident), F.col("source").alias(of), F.col("size").alias(words), F.col("copies").alias(copies), order.alias(place))
    numbered = materialise(numbered, "mix-repeats")
    known = docs.join(by_source, own_source.eqNullSafe(F.col(given)), "left")
    empty = F.coalesce(~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    known = known.withColumn(low, F.when(empty, F.lit(0)).otherwise(F.col(low))).withColumn(high, F.when(empty, F.lit(0)).otherwise(F.col(high)))
    alike = known.where(F.col(low) == F.col(high)).withColumn(copies, F.col(low))
    apart = known.where(F.col(low) < F.col(high)).select(docs.columns)
    once = apart.join(own.where(F.col(rows) == 1), this)
    again = apart.join(repeats, this, "left_semi").withColumn(size, word_count(F.col(text_col)))
    digest = F.sha2(F.to_json(F.struct(*docs.columns)), 256)
    again = again.withColumn(row, F.row_number().over(Window.partitionBy(own_id, own_source, F.col(size)).orderBy(digest)))
    again = again.join(numbered, this & (F.col(size) == F.col(words)) & (F.col(row) == F.col(place)))
    each = alike.select(*docs.columns, copies)
    for part in (once, again):
        each = each.unionByName(part.select(*docs.columns, copies))
    each = each.where(F.col(copies) > 0)
    return each.withColumn(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies).cast("long")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")

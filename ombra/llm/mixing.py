"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a keyed shuffled order and their words cut into blocks of equal
length. Slot t of the schedule belongs to the source in whose share of the cumulated targets the
point frac(t * golden ratio) falls, so any run of slots holds the sources near their weights.
Slots are ranked per source; slot r takes the source's block r, starting over when its words are
used up. Closing slots after the schedule bring each source to its target, and surplus slots are
cut, so a source's taken words are its rounded target, no more than three times its size, and no
document is taken more than three times.

Both running sums (words before a document, slots before a slot) are summed bucket by bucket, so a
source with most of the rows is no single task's work.

Defined results: a null text has size 0, is returned and nothing of it is taken; a null source is
a source of its own, ordered last; equal rows share a place and are told apart by order only, so
the result as a set of rows is always the same; other columns of the input are ignored; an empty
table, or one without words, has targets 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ombra.llm.common import documents, large, prefix_sums, written

#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: A source's target, and a document's use, stop at this multiple of its size.
MOST = 3
#: Words of a block.
BLOCK = 512
#: Slots of a partition of taken documents, where there are more partitions than four for each core.
RUN = 1 << 15
#: Slots of a chunk in which they are ranked together.
CHUNK = 1 << 16
SEED = "mix-1"
#: The golden ratio's fraction as a multiple of 2**-31; points repeat after 2**31 slots.
GOLDEN, POINTS = 1327217885, 1 << 31
#: A cell of points holds two to this power.
CELL = 19
#: Hexadecimal digits of the key that name a bucket of a source's shuffled order.
DIGITS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Rows (source, source_size, position, target) of rows (source, source_size).

    Shares follow the weights; sources that would pass ``most`` times their size are held there
    and their excess is shared again. That is a level: the target is the smaller of the bound and
    weight times the level, found from the running sums over sources in order of bound by weight.
    The table has a row for each source.
    """
    one = W.partitionBy(F.lit(0))
    n = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(n - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", n.alias("position"), weight.cast("double").alias("w"))
    rows = rows.select("*", (F.col("source_size") * most / F.col("w")).alias("ratio"), F.sum("source_size").over(one).alias("total"), F.sum("w").over(one).alias("all_w"))
    before = one.orderBy("ratio", "position").rowsBetween(W.unboundedPreceding, -1)
    held = F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    level = (F.col("total") - held) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.select("*", level.alias("level"))
    # the level is the first that its own source, and so all later ones, can bear
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "position", "level"))).over(one)["level"]
    target = F.least((F.col("source_size") * most).cast("double"), F.col("w") * F.coalesce(final, F.lit(float("inf"))))
    return rows.select("source", "source_size", "position", F.round(target, 6).alias("target"))


def mix_key(id_col: str, seed: str = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def shuffled(docs: DataFrame, source: Column, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """Rows (id, source, size, mix_key, begin): ``begin`` counts the words of the source before the document in shuffled order."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), source.cast("string").alias("source"), size_of(F.col(text_col)).alias("size"), mix_key(id_col, seed).alias("mix_key"))
    rows = rows.withColumn("bucket", F.conv(F.substring("mix_key", 1, DIGITS), 16, 10).cast("int"))
    rows, _ = written(rows, "mixing")
    return prefix_sums(rows, ["source"], "bucket", [F.col("mix_key"), F.col("size")], "size", "begin").drop("bucket")


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (slot, position, rank): the source of each slot in order and the slot's number within it.

    ``goals`` has (position, goal): words to take of each source. The points' slots come first;
    a source that they leave short is brought to its goal by closing slots after them.
    """
    spark = goals.sparkSession
    total = goals.agg(F.coalesce(F.sum("goal"), F.lit(0))).first()[0]
    n = -(-total // block)
    one = W.partitionBy(F.lit(0)).orderBy("position")
    share = F.sum("goal").over(one.rowsBetween(W.unboundedPreceding, W.currentRow))
    # each source's part of the points, as multiples of 2**-31
    cut = F.floor(share.cast("decimal(38,0)") * F.lit(POINTS).cast("decimal(38,0)") / F.greatest(F.lit(total), F.lit(1)).cast("decimal(38,0)")).cast("long")
    parts = goals.where("goal > 0").select("position", "goal", cut.alias("high")).select("*", F.coalesce(F.lag("high").over(one), F.lit(0).cast("long")).alias("low"))
    # points meet intervals by cell: an equi-join, with as many rows of intervals as cells and sources
    cells = parts.where("high > low").select("position", "low", "high", F.explode(F.sequence(F.shiftright("low", CELL), F.shiftright(F.col("high") - 1, CELL))).alias("cell"))
    point = F.pmod(F.pmod(F.col("id"), F.lit(POINTS)) * F.lit(GOLDEN), F.lit(POINTS))
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("point"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    slots = slots.withColumn("cell", F.shiftright("point", CELL)).join(cells, "cell").where("low <= point and point < high").select("slot", "chunk", "position")
    slots, _ = written(slots, "mixing")
    ranked = prefix_sums(slots.withColumn("one", F.lit(1).cast("long")), ["position"], "chunk", [F.col("slot")], "one", "rank").drop("one", "chunk")
    wanted = goals.select("position", F.ceil(F.col("goal") / F.lit(block)).cast("long").alias("wanted"))
    kept = ranked.join(wanted, "position").where("rank < wanted").select("slot", "position", "rank")
    have = kept.groupBy("position").agg(F.count(F.lit(1)).alias("have"))
    short = wanted.join(have, "position", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("wanted > have")
    short = short.withColumn("first", F.sum(F.col("wanted") - F.col("have")).over(one.rowsBetween(W.unboundedPreceding, W.currentRow)) - (F.col("wanted") - F.col("have")))
    tail = short.select("position", "have", "first", F.explode(F.sequence(F.col("have"), F.col("wanted") - 1)).alias("rank"))
    tail = tail.select((F.lit(n) + F.col("first") + F.col("rank") - F.col("have")).alias("slot"), "position", "rank")
    return kept.unionByName(tail)


def mix(docs: DataFrame, source: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows (id, source, size, mix_key, begin, source_size, target, position, taken, first_slot, n_uses), one for each row of ``docs``.

    ``first_slot`` is the first slot whose block holds words of the document, -1 if nothing of it is
    taken; ``n_uses`` counts the uses: once for each slot and pass over the source that takes words.
    """
    return mixture(docs, source, id_col, text_col, block)[0]


def mixture(docs: DataFrame, source: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """What ``mix`` gives, and the schedule (slot, position, rank)."""
    order, _ = written(shuffled(docs, source, id_col, text_col), "mixing")
    sizes = order.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims, _ = written(targets(sizes).withColumn("goal", F.least(F.round("target").cast("long"), F.col("source_size") * MOST)), "mixing")
    slots, _ = written(schedule(aims.select("position", "goal"), block), "mixing")
    # a slot is a run of the source's words, repeated end to end; cut at its end into runs of one pass
    aimed = slots.join(aims.select("position", "source_size", "goal"), "position")
    start, stop = F.col("rank") * block, F.least((F.col("rank") + 1) * block, F.col("goal"))
    turns = F.sequence(F.floor(start / F.col("source_size")), F.floor((stop - 1) / F.col("source_size")))
    runs = aimed.select("slot", "position", "source_size", start.alias("start"), stop.alias("stop"), F.explode(turns).alias("turn"))
    base = F.col("turn") * F.col("source_size")
    runs = runs.select("slot", "position", (F.greatest("start", base) - base).alias("a"), (F.least("stop", base + F.col("source_size")) - base).alias("b"))
    # equal-token blocks of the source: a run touches two at most, a document as many as it is long
    grid = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / block), F.floor((F.col(y) - 1) / block))).alias("block")
    runs = runs.select("slot", "position", "a", "b", F.floor(F.col("a") / block).alias("home"), grid("a", "b"))
    runs = runs.select("slot", "position", "home", "block", F.greatest("a", F.col("block") * block).alias("a"), F.least("b", (F.col("block") + 1) * block).alias("b"))
    # a run that goes on in the next block is counted there only for documents that begin in that block
    runs = runs.groupBy("position", "block", "a", "b", (F.col("block") > F.col("home")).alias("on")).agg(F.count(F.lit(1)).alias("times"), F.min("slot").alias("slot"))
    runs = runs.groupBy("position", "block").agg(F.collect_list(F.struct("a", "b", "times", "slot", "on")).alias("runs"))
    placed = order.join(aims, order["source"].eqNullSafe(aims["source"])).select(order["*"], "position", "source_size", "target")
    placed = placed.withColumn("row", F.struct("id", "mix_key", "begin", "size"))
    pieces = placed.where("size > 0").withColumn("end", F.col("begin") + F.col("size")).select("position", "row", "begin", "end", grid("begin", "end"))
    overlap = lambda r: F.greatest(F.least(r["b"], F.col("end")) - F.greatest(r["a"], F.col("begin")), F.lit(0))
    counted = lambda r: (overlap(r) > 0) & (~r["on"] | (F.col("begin") >= F.col("block") * block))
    used = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + overlap(r) * r["times"])
    uses = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + F.when(counted(r), r["times"]).otherwise(F.lit(0)))
    met = F.array_min(F.transform(F.filter("runs", lambda r: overlap(r) > 0), lambda r: r["slot"]))
    found = pieces.join(large(runs), ["position", "block"]).select("position", "row", used.alias("used"), uses.alias("uses"), met.alias("slot"))
    found = found.groupBy("position", "row").agg(F.sum("used").alias("used"), F.sum("uses").alias("uses"), F.min("slot").alias("first_slot"))
    found = found.select("position", F.col("row.mix_key").alias("mix_key"), F.col("row.begin").alias("begin"), F.col("row.size").alias("size"), "used", "uses", "first_slot")
    whole = placed.drop("row").join(large(found), ["position", "mix_key", "begin", "size"], "left")
    when = lambda c: F.when(F.col("size") > 0, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long")
    names = ("id", "source", "size", "mix_key", "begin", "source_size", "target", "position")
    return whole.select(*names, when("used").alias("taken"), F.when(F.col("size") > 0, F.coalesce("first_slot", F.lit(-1))).otherwise(F.lit(-1)).cast("long").alias("first_slot"), when("uses").alias("n_uses")), slots


def mixed(docs: DataFrame, source: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, to the nearest whole time, in the order of the schedule.

    A use stands where the slot that holds its first word stands; a partition has a run of slots, sorted.
    """
    found, slots = mixture(docs, source, id_col, text_col, block)
    last = slots.agg(F.coalesce(F.max("slot"), F.lit(0))).first()[0]
    # slots are as long as one another, so equal runs of them are ranges that need no sample
    tasks = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-(last + 1) // RUN))
    times = F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")
    uses = found.where("size > 0").select("mix_key", "size", "begin", "source_size", "position", times.alias("times")).where("times > 0")
    uses = uses.select("*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("turn"))
    # each use of a key gets a number, so that rows that share a key share its uses
    uses = uses.select("*", F.floor((F.col("turn") * F.col("source_size") + F.col("begin")) / block).alias("rank")).join(large(slots), ["position", "rank"])
    each = W.partitionBy("mix_key", "size")
    uses = uses.select("mix_key", "size", "slot", (F.row_number().over(each.orderBy("slot", "begin")) - 1).alias("use"))
    rows = docs.select(mix_key(id_col).alias("mix_key"), size_of(F.col(text_col)).alias("size"), F.struct("*").alias("doc"))
    rows = rows.select("*", (F.row_number().over(each.orderBy(F.xxhash64("doc"))) - 1).alias("n"), F.count(F.lit(1)).over(each).alias("rows"))
    met = rows.join(large(uses), ["mix_key", "size"]).where(F.pmod("use", "rows") == F.col("n"))
    runs = met.repartitionById(tasks, F.floor(F.col("slot") * tasks / F.lit(last + 1)).cast("int"))
    return runs.sortWithinPartitions("slot", "mix_key", "use").select("doc.*")


def op5_sql(block: int = BLOCK) -> str:
    """The mix in SQL: the taken words follow from the goals (whole passes, then the part of the last), slots and uses from the schedule."""
    return SQL.replace("{block}", str(block)).replace("{golden}", str(GOLDEN)).replace("{points}", str(POINTS))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents
), p AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS b FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM s
), w AS (
  SELECT *, CAST([1, 2, 3][(pos - 1) % 3 + 1] AS DOUBLE) AS w FROM n
), r AS (
  SELECT *, source_size * 3 / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM w
), l AS (
  SELECT *, (total - coalesce(sum(source_size * 3) OVER before, 0)) / (all_w - coalesce(sum(w) OVER before, 0)) AS level
  FROM r WINDOW before AS (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT arg_min(level, (ratio, pos)) AS final FROM l WHERE level <= ratio
), t AS (
  SELECT source, source_size, round(least(source_size * 3.0, w * final), 6) AS target FROM l, f
), g AS (
  SELECT *, least(CAST(round(target) AS BIGINT), source_size * 3) AS goal FROM t
), h AS (
  SELECT n.pos, g.*, sum(goal) OVER (ORDER BY n.pos) AS share, sum(goal) OVER () AS words, (goal + {block} - 1) // {block} AS wanted
  FROM g JOIN n ON g.source IS NOT DISTINCT FROM n.source
), i AS (
  SELECT *, coalesce(lag(high) OVER (ORDER BY pos), 0) AS low
  FROM (SELECT *, CAST(floor(share * {points} / CAST(greatest(words, 1) AS HUGEINT)) AS BIGINT) AS high FROM h WHERE goal > 0)
), c AS (
  SELECT CAST((coalesce(max(words), 0) + {block} - 1) // {block} AS BIGINT) AS n FROM h
), x AS (
  SELECT slot, pos, row_number() OVER (PARTITION BY pos ORDER BY slot) - 1 AS rank, wanted
  FROM (SELECT range AS slot, (range % {points}) * {golden} % {points} AS point FROM range((SELECT n FROM c))) JOIN i ON low <= point AND point < high
), y AS (
  SELECT pos, goal, wanted, coalesce((SELECT count(*) FROM x WHERE x.pos = h.pos AND rank < x.wanted), 0) AS have FROM h
), z AS (
  SELECT *, sum(wanted - have) OVER (ORDER BY pos) - (wanted - have) AS first FROM y WHERE wanted > have
), o AS (
  SELECT slot, pos, rank FROM x WHERE rank < wanted
  UNION ALL
  SELECT c.n + first + rank - have, pos, rank FROM (SELECT *, unnest(range(have, wanted)) AS rank FROM z), c
), q AS (
  SELECT slot, o.pos, rank * {block} AS start, least((rank + 1) * {block}, goal) AS stop, source_size FROM o JOIN h ON o.pos = h.pos
), m AS (
  SELECT *, unnest(range(start // source_size, (stop - 1) // source_size + 1)) AS turn FROM q
), u AS (
  SELECT slot, pos, greatest(start - turn * source_size, 0) AS a, least(stop - turn * source_size, source_size) AS b FROM m
), v AS (
  SELECT d.source, d.k, d.size, d.b, min(slot) AS first_slot, count(*) AS n_uses
  FROM p AS d JOIN n ON d.source IS NOT DISTINCT FROM n.source JOIN u ON u.pos = n.pos AND u.a < d.b + d.size AND d.b < u.b
  WHERE d.size > 0 GROUP BY ALL
)
SELECT p.doc_id, p.size, g.source_size, CAST(g.target AS DOUBLE) AS target,
       CAST(CASE WHEN p.size = 0 THEN 0 ELSE p.size * (goal // g.source_size)
         + least(goal % g.source_size, p.b + p.size) - least(goal % g.source_size, p.b) END AS BIGINT) AS taken,
       CAST(coalesce(v.first_slot, -1) AS BIGINT) AS first_slot, CAST(coalesce(v.n_uses, 0) AS BIGINT) AS n_uses
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
LEFT JOIN v ON p.source IS NOT DISTINCT FROM v.source AND p.k = v.k AND p.size = v.size AND p.b = v.b
"""
OP5_SQL = op5_sql()


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """One row for each document; nulls, empty texts and repeated rows as at the top."""
    found = mix(documents(spark, sf_dir), F.col("source"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot", "n_uses")

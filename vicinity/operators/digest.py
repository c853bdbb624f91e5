"""Digests: clusters as one entry each, promotion of candidates, size-limited chunks, rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vicinity.functions import text
from vicinity.functions.shared import forget, keep

# Limits of a message.
MAX_BYTES = 8000
MAX_ITEMS = 15
MAX_SCORE = 5
REPEAT_HOURS = 48


def boosted(best: Column, sources: Column) -> Column:
    """A point more where several sources report, up to the top."""
    return F.when(sources > 1, F.least(best + 1, F.lit(MAX_SCORE))).otherwise(best)


def seeds(items: DataFrame) -> DataFrame:
    """Rows as entries of their own."""
    return items.withColumns({"guids": F.array("guid"), "source_count": F.lit(1)})


def merge(items: DataFrame) -> DataFrame:
    """One entry for each ``cluster``: its first member stands for it, sources are named once each."""
    top = F.struct("title", "link", "link_note", "max_score", "distance_meters", "location_label")
    groups = items.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("guid")))).alias("m"), F.min_by(top, "rank").alias("first"), F.max("score").alias("best"))
    named = items.groupBy("cluster", F.lower("source_name").alias("k")).agg(F.min(F.struct("rank", "source_name")).alias("name"))
    names = named.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list("name")), lambda x: x["source_name"]).alias("names"))
    return groups.join(names, "cluster").select(
        "cluster", F.transform("m", lambda x: x["guid"]).alias("guids"), F.array_join("names", " + ").alias("source_name"), F.size("names").alias("source_count"),
        *[F.col(f"first.{c}").alias(c) for c in ("title", "link", "link_note", "max_score", "distance_meters", "location_label")],
        boosted(F.col("best"), F.size("names")).alias("score"),
    )


def promoted(items: DataFrame, min_score: int, min_sources: int) -> DataFrame:
    """(id): candidates in clusters with enough sources whose boosted best score is high enough."""
    source = F.lower("source_name")
    good = items.groupBy("cluster").agg(F.count_distinct(source).alias("sources"), F.max("score").alias("best"))
    good = good.where((F.col("sources") >= max(min_sources, 2)) & (boosted(F.col("best"), F.col("sources")) >= min_score))
    return items.where("state = 'candidate'").join(good, "cluster", "left_semi").select("id")


def entry_bytes(title: Column, source: Column, link: Column, sources: Column) -> Column:
    return F.octet_length(title) + F.octet_length(source) + F.coalesce(F.octet_length(link), F.lit(0)) + sources * 8 + 50


#: Entries whose jumps one row holds.
BLOCK = 512


def numbered(rows: DataFrame, order: list[Column], keys: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: their place (from 0) in ``order`` within ``keys``, kept.  Rows are sorted in
    ranges, and a range begins where the counts of those before it end: no key is one task."""
    if keys:
        ranged = rows.repartitionByRange(*keys, *order)
    else:
        ranged = rows.repartitionByRange(*order)
    ranged = keep(ranged.withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_n"))  # a row for each range and key
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).drop("_n")
    within = F.row_number().over(W.partitionBy("_range", *keys).orderBy(*order)) - 1
    same = F.col("r._range") == F.col("s._range")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    placed = ranged.withColumn("_within", within).alias("r").join(starts.alias("s"), same)
    return keep(placed.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("_before") + F.col("_within")).alias(name)), "placed")


def _jumps(placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, jumps): for each entry, in order, how many entries the chunk has that begins with it.
    A block gets the entries behind it that its last ones may reach."""
    at, block = F.col("_at"), F.floor(F.col("_at") / BLOCK)
    halo = placed.where((at >= BLOCK) & (at % BLOCK < MAX_ITEMS - 1)).select(*keys, "_at", "_bytes", (block - 1).alias("_block"))
    rows = placed.select(*keys, "_at", "_bytes", block.alias("_block")).unionByName(halo)
    ahead = F.collect_list("_bytes").over(W.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(0, MAX_ITEMS - 1))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("open"))

    def take(s: Column, b: Column) -> Column:
        fits = s["open"] & ((s["n"] == 0) | (s["bytes"] + b <= MAX_BYTES))
        return F.struct((s["n"] + fits.cast("int")).alias("n"), F.when(fits, s["bytes"] + b).otherwise(s["bytes"]).alias("bytes"), fits.alias("open"))

    fitted = rows.withColumn("_n", F.aggregate(ahead, start, take, lambda s: s["n"])).where(block == F.col("_block"))
    return fitted.groupBy(*keys, "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_n"))), lambda x: x["_n"]).alias("jumps"))


def _lanes(jumps: Column) -> Column:
    """For each entry that may begin a chunk first in a block: where the first chunk of the next block begins
    then, and the chunks that begin in this one.  Read from the end, each entry takes over what the one it
    jumps to has; at most ``MAX_ITEMS`` are at hand."""
    blank = F.array().cast("array<struct<exit:int,n:int>>")

    def back(s: Column, jump: Column) -> Column:
        beyond = jump > F.size(s["lanes"])
        to = F.get(s["lanes"], jump - 1)
        lane = F.struct(F.when(beyond, jump - 1 - s["behind"]).otherwise(to["exit"]).cast("int").alias("exit"), F.when(beyond, 1).otherwise(to["n"] + 1).cast("int").alias("n"))
        return F.struct((s["behind"] + 1).cast("int").alias("behind"), F.slice(F.concat(F.array(lane), s["lanes"]), 1, MAX_ITEMS).alias("lanes"))

    return F.aggregate(F.reverse(jumps), F.struct(F.lit(0).alias("behind"), blank.alias("lanes")), back, lambda s: s["lanes"])


def chunks(entries: DataFrame, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """``entries`` with ``place`` (from 1) and ``chunk`` (from 0): in order, a new chunk where an entry would
    exceed the limits; ``group`` keeps digests apart.

    An entry that begins a chunk says where the next one begins, at most ``MAX_ITEMS`` on.  Entries are cut
    into blocks, each of which says where one comes out for each way to come in; these jumps are doubled
    over blocks until each is known from the first one, and blocks then number their own chunks.  So a digest
    of any size is work for many tasks, in rounds as many as the logarithm of its blocks."""
    size = entry_bytes(F.col("title"), F.col("source_name"), F.col("link"), F.col("source_count")).cast("long")
    keys = [f"_key{i}" for i in range(len(group or []))]
    keyed = entries.withColumns({k: F.col(g) for k, g in zip(keys, group or [], strict=True)} | {"_bytes": F.coalesce(size, F.lit(0))})
    placed = numbered(keyed, order, keys, "_at")
    jumps = keep(_jumps(placed, keys), "jumps")
    reached = keep(jumps.select(*keys, "_block", _lanes(F.col("jumps")).alias("lanes")), "lanes")
    on = lambda a, b, step: reduce(lambda x, k: x & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")), keys, F.col(f"{a}._block") == F.col(f"{b}._block") + step)
    step, blocks = 1, (reached.agg(F.max("_block")).first()[0] or 0) + 1
    while step < blocks:
        through = F.transform("p.lanes", lambda e: F.struct(F.get("b.lanes", e["exit"])["exit"].alias("exit"), (e["n"] + F.get("b.lanes", e["exit"])["n"]).alias("n")))
        joined = reached.alias("b").join(reached.alias("p"), on("b", "p", step), "left")
        before, reached = reached, keep(joined.select(*[F.col(f"b.{k}") for k in keys], "b._block", F.when(F.col("p._block").isNull(), F.col("b.lanes")).otherwise(through).alias("lanes")), "lanes")
        forget(before)
        step *= 2
    came = jumps.alias("j").join(reached.alias("r"), on("j", "r", 1), "left")
    first = F.struct(F.coalesce(F.col("r.lanes")[0]["exit"], F.lit(0)).alias("next"), (F.coalesce(F.col("r.lanes")[0]["n"], F.lit(0)) - 1).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def walk(s: Column, jump: Column) -> Column:
        begins = s["next"] == 0
        chunk = s["chunk"] + begins.cast("int")
        return F.struct((F.when(begins, jump).otherwise(s["next"]) - 1).alias("next"), chunk.alias("chunk"), F.concat(s["out"], F.array(chunk)).alias("out"))

    walked = came.select(*[F.col(f"j.{k}") for k in keys], F.col("j._block").alias("_block"), F.posexplode(F.aggregate("j.jumps", first, walk, lambda s: s["out"])).alias("_pos", "chunk"))
    told = walked.select(*keys, (F.col("_block") * BLOCK + F.col("_pos")).alias("_at"), "chunk")
    same = reduce(lambda x, k: x & F.col(f"e.{k}").eqNullSafe(F.col(f"t.{k}")), keys, F.col("e._at") == F.col("t._at"))
    return placed.alias("e").join(told.alias("t"), same).select(*[F.col(f"e.{c}") for c in entries.columns], (F.col("e._at") + 1).cast("int").alias("place"), F.col("t.chunk").alias("chunk"))


def render(entries: DataFrame, header: Column) -> DataFrame:
    """``entries`` with ``plain`` and ``html`` lines of one entry; :func:`message` joins them."""

    def lines(esc, strong: str, end: str) -> list[Column]:
        where = F.concat_ws(" · ", text.format_distance(F.col("distance_meters")), F.nullif(esc(F.col("location_label")), F.lit("")))
        return [
            F.concat(text.score_color(F.col("score")), F.lit(" " + strong), esc(F.col("title")), F.lit(end)),
            F.concat(F.lit("📰 "), esc(F.col("source_name")), F.lit(" · ⭐ "), F.col("score").cast("string"), F.lit("/"), F.col("max_score").cast("string"), F.when(F.col("source_count") > 1, F.concat(F.lit(" · 👥 "), F.col("source_count").cast("string"), F.lit(" sources"))).otherwise(F.lit(""))),
            F.when(where != "", F.concat(F.lit("📍 "), where)),
        ]

    note = F.when(F.col("link_note").isNotNull(), F.concat(F.lit(" ("), F.col("link_note"), F.lit(")"))).otherwise(F.lit(""))
    link = F.when(F.col("link").isNotNull(), F.concat(F.lit("🔗 "), F.col("link"), note))
    safe = text.html_escape(F.col("link"))
    anchor = F.when(F.col("link").isNotNull(), F.concat(F.lit('🔗 <a href="'), safe, F.lit('">'), safe, F.lit("</a>"), text.html_escape(note)))
    plain = F.concat_ws("\n", *lines(lambda c: c, "", ""), link)
    html = F.concat_ws("<br>", *lines(text.html_escape, "<strong>", "</strong>"), anchor)
    return entries.withColumns({"plain": plain, "html": html, "header": header})


def message(entries: DataFrame, key: str = "chunk") -> DataFrame:
    """(key, plain, html): one message for each chunk; a chunk has ``MAX_ITEMS`` entries at most."""
    got = entries.groupBy(key, "header").agg(F.array_sort(F.collect_list(F.struct("place", "plain", "html"))).alias("m"))
    body = lambda name, sep: F.array_join(F.transform("m", lambda x: x[name]), sep)
    return got.select(key, F.concat("header", F.lit("\n\n"), body("plain", "\n\n")).alias("plain"), F.concat(text.html_escape(F.col("header")), F.lit("<br><br>"), body("html", "<br><br>")).alias("html"))


def post_key(slot: Column, guids: Column, prefix: str = "vicinity") -> Column:
    return F.concat(F.lit(f"{prefix}:digest:"), slot, F.lit(":"), F.array_join(guids, ","))

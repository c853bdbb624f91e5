"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent from 0 (all alike) to 1 (as they
are).  The exponent is bisected to the smallest that keeps every source's repetition within a limit,
or to the one whose weights have a target entropy.  Without a budget the mix is the smallest in which
every source is used at least once in full, so no document is lost; with a budget of tokens, weights
are shares of it.

A source's documents are dealt into blocks by a hash of their key and text.  Each full pass takes all
blocks in a hashed order of its own; the last, partial pass takes blocks in its order while they fit the
rest of the source's budget, and then documents of the next block in hashed order while they fit.
Decisions are made on the table of blocks (one row for some ``block_tokens`` tokens), and documents
join it by source and block.  Running sums over a source's blocks are made in slices of the hash, whose
totals are added up, so that no task holds all blocks of a source.

Null sources are a source of their own.  Null keys are like any other, so rows without a key are told
apart by their text.  Rows with equal keys and texts are taken or left together.  Only DataFrame
functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vicinity.llm.common import WORD, fresh, look_up, save

REPETITION = 1.5
BLOCK_TOKENS = 50_000
STEPS = 40
#: Exponents tried in one pass over the sources when an entropy is the target: five steps of bisection.
GRID = 32


def token_count(text: str) -> Column:
    """Words of ASCII white space, and one for the end of the document."""
    return (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)) + 1).cast("long")


def repetition_exponent(least: int, most: int, limit: float) -> float:
    """The smallest exponent for which the smallest source is used at most ``limit`` times as often as
    the largest."""
    low, high = 0.0, 1.0
    if limit < 1:
        raise ValueError("a repetition limit is 1 or more")
    if (most / least) ** (1 - low) <= limit:
        return 0.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        if (most / least) ** (1 - mid) <= limit:
            high = mid
        else:
            low = mid
    return round(high, 9)


def entropy_exponent(sizes: DataFrame, tokens: str, target: float) -> float:
    """The exponent whose weights have the entropy ``target`` (natural logarithm), from 0 to 1; where
    none has, the nearer end.  Each pass evaluates a grid of exponents in one aggregation."""
    low, high, total = 0.0, 1.0, sizes.agg(F.sum(tokens)).first()[0]
    share = F.log(F.col(tokens) / F.lit(total))
    for _ in range(6):
        tried = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        row = sizes.agg(*[x for i, a in enumerate(tried) for x in (F.sum(F.exp(share * a)).alias(f"s{i}"), F.sum(F.exp(share * a) * share * a).alias(f"t{i}"))]).first()
        above = [i for i in range(GRID + 1) if math.log(row[f"s{i}"]) - row[f"t{i}"] / row[f"s{i}"] >= target]  # entropy falls as the exponent grows
        at = max(above, default=-1)
        if at == GRID:
            return round(high, 9)
        if at < 0:
            return round(low, 9)
        low, high = tried[at], tried[at + 1]
    return round((low + high) / 2, 9)


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts]))


def earlier(rows: DataFrame, groups: list[str], turn: str, tie: str, amount: Column) -> DataFrame:
    """``rows`` (a saved table) with ``before``: the sum of ``amount`` over the rows of their group that
    come before them by ``turn`` (a hex hash) and ``tie``.  Slices of the hash are summed first."""
    dealt = rows.withColumns({"slice": F.substring(turn, 1, SLICE), "amount": amount})
    sums = dealt.groupBy(*groups, "slice").agg(F.sum("amount").alias("amount"))
    base = F.sum("amount").over(W.partitionBy(*groups).orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    own = F.sum("amount").over(W.partitionBy(*groups, "slice").orderBy(turn, tie).rowsBetween(W.unboundedPreceding, -1))
    placed = dealt.withColumn("own", F.coalesce(own, F.lit(0))).join(sums.select(*groups, "slice", F.coalesce(base, F.lit(0)).alias("base")), [*groups, "slice"])
    return placed.withColumn("before", F.col("base") + F.col("own")).drop("slice", "amount", "base", "own")


#: Hexadecimal digits of a hash that make a slice: 4096 slices.
SLICE = 3


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = "mix") -> DataFrame:
    """``docs``, all columns, each row once for each time it is used, with ``mix_tokens``, ``mix_epoch``
    (pass, from 0), ``mix_block`` and ``mix_rank`` (place of its block in that pass); where ``docs``
    has one of these, the new one is underscored.  Give either ``repetition`` or ``entropy``.  An
    empty table gives an empty one; empty texts have one token."""
    if entropy is None and repetition is None:
        raise ValueError("give a repetition limit or a target entropy")
    tokens, epoch, block, rank, name, ident, order, total, uses, use, weight = fresh(docs, "mix_tokens", "mix_epoch", "mix_block", "mix_rank", "mix_source", "mix_key", "mix_order", "mix_blocks", "mix_uses", "mix_use", "mix_weight")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumns({tokens: token_count(text), name: F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")), ident: F.coalesce(F.col(key).cast("string"), F.lit(""))})
    rows = rows.withColumn(order, _hash(seed, F.col(ident), F.md5(F.coalesce(F.col(text), F.lit("")))))
    thin = save(rows.select(F.col(name).alias("name"), F.col(tokens).alias("tokens"), F.col(order).alias("hash")), "mix")
    sizes = save(thin.groupBy("name").agg(F.sum("tokens").alias("total")), "sizes")
    ends = sizes.agg(F.min("total").alias("least"), F.max("total").alias("most")).first()
    if ends["most"] is None:
        return rows.select(*own, tokens, F.lit(0).alias(epoch), F.lit(0).cast("long").alias(block), F.lit(0).alias(rank))
    exponent = entropy_exponent(sizes, "total", entropy) if entropy is not None else repetition_exponent(ends["least"], ends["most"], repetition)
    scale = ends["most"] ** (1 - exponent) if budget is None else budget / sizes.agg(F.sum(F.pow(F.col("total").cast("double"), F.lit(exponent)))).first()[0]
    passes = F.pow(F.col("total").cast("double"), F.lit(exponent - 1)) * F.lit(float(scale))
    plan = sizes.withColumn("passes", passes).withColumn("full", F.floor(F.col("passes") + 1e-9).cast("int"))
    plan = plan.select("name", "total", "full", F.greatest(F.lit(0), F.floor((F.col("passes") - F.col("full")) * F.col("total") + 1e-6)).cast("long").alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens)).cast("long").alias("blocks"))
    number = F.pmod(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long"), F.col("blocks"))
    # the table of blocks, and what of each the partial pass takes: all of it, a part, nothing
    blocks = look_up(thin, plan, "name", "total", ["hash"]).groupBy("name", "full", "rest", number.alias("block")).agg(F.sum("tokens").alias("tokens"))
    turn = _hash(seed, F.col("full").cast("string"), F.col("name"), F.col("block").cast("string"))
    blocks = save(blocks.withColumn("turn", turn), "blocks")
    part = earlier(blocks, ["name"], "turn", "block", F.col("tokens"))
    part = part.select("name", "block", "full", F.when(F.col("before") + F.col("tokens") <= F.col("rest"), F.lit("all")).when(F.col("before") < F.col("rest"), F.lit("part")).otherwise(F.lit("none")).alias("extra"), (F.col("rest") - F.col("before")).alias("room"))
    # a source has one block that is taken in part; equal keys and texts are one row of it
    numbered = look_up(thin, plan, "name", "total", ["hash"]).select("name", number.alias("block"), "tokens", "hash")
    cut = numbered.join(part.where("extra = 'part'").select("name", "block", "room"), ["name", "block"]).groupBy("name", "block", "room", "hash").agg(F.sum("tokens").alias("tokens"))
    running = F.sum("tokens").over(W.partitionBy("name", "block").orderBy("hash").rowsBetween(W.unboundedPreceding, 0))
    last = cut.withColumn("sum", running).where("sum <= room").groupBy("name", "block").agg(F.max("hash").alias("last"))
    part = part.join(last, ["name", "block"], "left")
    epochs = part.select("name", "block", "full", "extra", "last", F.explode(F.expr("filter(sequence(0, full), e -> e < full or extra <> 'none')")).alias("mix_epoch"))
    epochs = save(epochs.withColumn("turn", _hash(seed, F.col("mix_epoch").cast("string"), F.col("name"), F.col("block").cast("string"))), "epochs")
    placed = earlier(epochs, ["name", "mix_epoch"], "turn", "block", F.lit(1)).withColumn("mix_rank", F.col("before").cast("int"))
    taken = placed.groupBy("name", "block").agg(F.sort_array(F.collect_list(F.struct("mix_epoch", "mix_rank", ((F.col("mix_epoch") == F.col("full")) & (F.col("extra") == "part")).alias("partly"), "last"))).alias("uses"))
    taken = save(taken.select(F.col("name").alias(name), F.col("block").alias(block), F.col("uses").alias(uses)), "uses")
    counts = plan.select(F.col("name").alias(name), F.col("blocks").alias(total), F.col("total").alias(weight))
    dealt = look_up(rows, counts, name, weight, [order]).withColumn(block, F.pmod(F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), F.col(total))).join(taken, [name, block])
    used = dealt.withColumn(use, F.explode(uses)).where(~F.col(f"{use}.partly") | (F.col(order) <= F.col(f"{use}.last")))
    return used.select(*own, tokens, F.col(f"{use}.mix_epoch").alias(epoch), block, F.col(f"{use}.mix_rank").alias(rank))


def _search_sql(repetition: float | None, entropy: float | None) -> str:
    """WITH tables that end in ``chosen``, the exponent."""
    if entropy is None:
        return f"""
    search(step, low, high) AS (
        SELECT 0, 0.0::DOUBLE, CASE WHEN most / least <= {repetition}::DOUBLE THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END FROM ends
        UNION ALL
        SELECT step + 1, CASE WHEN pow(most / least, 1 - (low + high) / 2) <= {repetition}::DOUBLE THEN low ELSE (low + high) / 2 END,
               CASE WHEN pow(most / least, 1 - (low + high) / 2) <= {repetition}::DOUBLE THEN (low + high) / 2 ELSE high END
        FROM search, ends WHERE step < {STEPS}),
    chosen AS (SELECT round(high, 9) AS exponent FROM search WHERE step = {STEPS})"""
    steps = "".join(f"""
    tried{k} AS (SELECT low, high, i, low + (high - low) * i / {GRID} AS a FROM range{k - 1}, range({GRID + 1}) AS r(i)),
    found{k} AS (SELECT i, min(low) AS low, min(high) AS high, min(a) AS a, ln(sum(exp(ln(total / all_tokens) * a))) - sum(exp(ln(total / all_tokens) * a) * ln(total / all_tokens) * a) / sum(exp(ln(total / all_tokens) * a)) AS h
               FROM tried{k}, sizes, (SELECT sum(total)::DOUBLE AS all_tokens FROM sizes) GROUP BY i),
    range{k} AS (SELECT coalesce(max(a) FILTER (h >= {entropy!r}::DOUBLE), min(low)) AS low, coalesce(min(a) FILTER (i > (SELECT coalesce(max(i) FILTER (h >= {entropy!r}::DOUBLE), -1) FROM found{k}) AND (SELECT bool_or(h >= {entropy!r}::DOUBLE) FROM found{k})), CASE WHEN bool_or(h >= {entropy!r}::DOUBLE) THEN min(high) ELSE min(low) END) AS high FROM found{k}),""" for k in range(1, 7))
    return f"""
    range0 AS (SELECT 0.0::DOUBLE AS low, 1.0::DOUBLE AS high),{steps}
    chosen AS (SELECT round((low + high) / 2, 9) AS exponent FROM range6)"""


def mix_sql(repetition: float | None = REPETITION, entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = "mix", table: str = "documents") -> str:
    """(doc_id, source, n_tokens, epoch, block, block_rank) of the same mix in DuckDB's SQL."""
    return f"""
    WITH RECURSIVE thin AS (
        SELECT doc_id, source, coalesce('=' || source, '') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS tokens,
               md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS hash FROM {table}),
    sizes AS (SELECT name, sum(tokens)::BIGINT AS total FROM thin GROUP BY name),
    ends AS (SELECT min(total)::DOUBLE AS least, max(total)::DOUBLE AS most FROM sizes),{_search_sql(repetition, entropy)},
    passes AS (SELECT name, total, pow(total::DOUBLE, exponent - 1) * pow(most, 1 - exponent) AS passes FROM sizes, ends, chosen),
    plan AS (SELECT name, total, CAST(floor(passes + 1e-9) AS INTEGER) AS full_passes,
             greatest(0, CAST(floor((passes - floor(passes + 1e-9)) * total + 1e-6) AS BIGINT)) AS rest, greatest(1, CAST(ceil(total / {block_tokens}.0) AS BIGINT)) AS blocks FROM passes),
    numbered AS (SELECT t.*, full_passes, rest, ('0x' || substr(hash, 1, 8))::BIGINT % blocks AS block FROM thin t JOIN plan USING (name)),
    block_sizes AS (SELECT name, block, full_passes, rest, sum(tokens)::BIGINT AS tokens FROM numbered GROUP BY ALL),
    part AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY name ORDER BY md5('{seed}:' || full_passes || ':' || name || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM block_sizes),
    extra AS (SELECT name, block, full_passes, rest - before AS room, CASE WHEN before + tokens <= rest THEN 'all' WHEN before < rest THEN 'part' ELSE 'none' END AS extra FROM part),
    epochs AS (SELECT name, block, full_passes, extra, room, unnest(range(0, full_passes + CASE WHEN extra = 'none' THEN 0 ELSE 1 END)) AS epoch FROM extra),
    placed AS (SELECT *, row_number() OVER (PARTITION BY name, epoch ORDER BY md5('{seed}:' || epoch || ':' || name || ':' || block), block) - 1 AS block_rank FROM epochs),
    used AS (SELECT n.*, p.epoch, p.block_rank, p.extra, p.room, sum(n.tokens) OVER (PARTITION BY n.name, n.block, p.epoch ORDER BY n.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
             FROM numbered n JOIN placed p USING (name, block))
    SELECT doc_id, source, CAST(tokens AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch, block, CAST(block_rank AS INTEGER) AS block_rank
    FROM used WHERE epoch < full_passes OR extra = 'all' OR running <= room"""

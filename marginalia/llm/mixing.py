"""Mixing sources to target weights: a hierarchical token budget, then a token-prefix of seeded epochs for each leaf.

Documents are leaves of a tree domain > language > source. A budget of tokens goes down the tree by weight. A child
that can't use its share (its documents, repeated ``max_epochs`` times, hold fewer tokens) gets what it can hold, and
the rest goes to its siblings by weight; a node as a whole is never given more than it can hold, so only what all
siblings together can't take reaches the ancestors' other children. A leaf then takes its budget from an endless row of
epochs, each an order of all its documents by a seeded hash: whole epochs, and the prefix of the next one that fits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_ROWS, carried, joined_evenly, written

LEVELS = ("domain", "lang", "source")

#: Targets of the registered query; names that aren't listed weigh 1.
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "fr": 2, "de": 2, "es": 1},
    "source": {},
}
BUDGET_SHARE, MAX_EPOCHS, SEED = 0.8, 2, 17

#: An epoch's order is cut into so many equal ranges of its hash, and the one in which a budget ends into as many again;
#: only the rows of the last one are sorted.
RANGES, HASH_BITS = 1024, 60


def default_domain(source: Column) -> Column:
    """Sources are dealt to four domains by the number that ends their name (none: 0)."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source, r"([0-9]{1,9})$", 1).try_cast("long"), F.lit(0).cast("long")) % 4)


def tokens(text: Column) -> Column:
    """An estimate from the text alone: a token for each four characters begun."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def weight(name: Column, targets: Mapping[str, int]) -> Column:
    if not targets:
        return F.lit(1).cast("long")
    names = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    return F.coalesce(F.try_element_at(names, name), F.lit(1)).cast("long")


def share_out(children: DataFrame, parents: Sequence[str]) -> DataFrame:
    """``children`` with ``given``: each parent's ``budget`` dealt by ``weight`` to children that hold ``cap`` at most.

    In order of cap per weight, a child is full if its share of what the children before it left is no less than its
    cap; those after the last full one divide the rest by weight, rounded down. Exact whole-number arithmetic.
    """
    big = lambda c: F.col(c).cast("decimal(38,0)")
    whole = W.partitionBy(*parents)
    order = whole.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight").cast("double")).asc_nulls_last(), *LEVELS)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    sized = children.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_on": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    sized = sized.withColumn("full", big("cap") * big("weight_on") <= big("weight") * (big("budget") - big("cap_before")))
    sized = sized.withColumns({
        "left": F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole),
        "open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole),
    })
    part = F.expr("cast(cast(left as decimal(38,0)) * weight div nullif(open, 0) as bigint)")
    return sized.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(part, F.lit(0).cast("long")))).drop(
        "cap_before", "weight_on", "full", "left", "open", "weight", "cap", "budget"
    )


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], budget_share: float, max_epochs: int) -> DataFrame:
    """domain, lang, source, held (tokens) and given (tokens) of each leaf; ``leaves``: domain, lang, source, held."""
    parents: list[str] = []
    weights_of = [weight(F.col(x), weights.get(x, {})) for x in LEVELS]
    capped = leaves.withColumn("cap", F.when(F.least(*weights_of) > 0, F.col("held") * max_epochs).otherwise(0).cast("long"))
    sums = capped.groupBy().agg(F.coalesce(F.sum("held"), F.lit(0)).alias("held"), F.coalesce(F.sum("cap"), F.lit(0)).alias("cap")).first()
    budget = min(int(sums["held"] * budget_share), sums["cap"])
    above = None
    for level in LEVELS:
        here = [*parents, level]
        nodes = capped.groupBy(*here).agg(F.sum("cap").alias("cap"))
        nodes = nodes.select(*here, *[F.lit("").alias(x) for x in LEVELS if x not in here], "cap", weight(F.col(level), weights.get(level, {})).alias("weight"))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("long"))
        else:
            nodes = nodes.join(above, parents)
        given = share_out(nodes, parents).select(*here, "given")
        above, parents = given.withColumnRenamed("given", "budget"), here
    return leaves.join(above.withColumnRenamed("budget", "given"), list(LEVELS))


def beside(df: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` joined with a written table of a row a leaf, whose rows number ``rows`` in ``df``: broadcast if small."""
    if table.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table.drop("rows")), list(on))
    return joined_evenly(df, table, on, "rows")


def cuts_of(ordered: DataFrame, leaf: Sequence[str]) -> DataFrame:
    """For each leaf (of rows with ``rest``, ``at`` and ``tokens``): over (its rest ends within its epoch), and then the
    range of ``at`` in which it ends (cut, of RANGES * RANGES) and the tokens before that range.

    Two rounds of RANGES sums a leaf, so that the range holds a millionth of a leaf's rows, however many these are.
    """
    bits = (RANGES - 1).bit_length()

    def reached(all_: Column, start: Column) -> Column:
        state = lambda before, cut, over: F.struct(before.alias("before"), cut.alias("cut"), F.lit(over).alias("over"))
        return F.aggregate(
            all_,
            state(start, F.lit(-1).cast("long"), False),
            lambda acc, r: F.when(acc["over"], acc).otherwise(
                F.when(acc["before"] + r["n"] > F.col("rest"), state(acc["before"], r["part"], True)).otherwise(state(acc["before"] + r["n"], r["part"], False))
            ),
        )

    def cut(rows: DataFrame, level: int) -> DataFrame:
        by = [*leaf, "rest", "start"]
        sums = rows.groupBy(*by, F.shiftright("at", HASH_BITS - level * bits).alias("part")).agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("rows"))
        whole = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("all"), F.sum("rows").alias("rows"))
        return written(whole.select(*leaf, reached(F.col("all"), F.col("start")).alias("r"), "rows").select(*leaf, "r.*", "rows"), "cuts")

    first = cut(ordered.withColumn("start", F.lit(0).cast("long")), 1)
    within = beside(ordered, first.where("over").withColumnRenamed("before", "start"), leaf).where(F.shiftright("at", HASH_BITS - bits) == F.col("cut"))
    finer = cut(within.drop("cut", "over"), 2).select(*leaf, F.col("before").alias("finer_before"), F.col("cut").alias("finer_cut"))
    return written(first.join(finer, list(leaf), "left").select(*leaf, "over", F.coalesce("finer_before", "before").alias("before"), F.col("finer_cut").alias("cut"), "rows"), "cuts")


def mix(
    docs: DataFrame, domain: Column | None = None, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, budget_share: float = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS, seed: int = SEED, size: Column | None = None,
) -> DataFrame:
    """One row for each use of a document: its columns, domain, tokens, and epoch (from 0).

    ``budget_share``: the budget as a share of all tokens of ``docs`` (less, if the tree can't hold it). ``size``: the
    tokens of a row, if they have been counted (null: none); an estimate from the text stands in. A null language or
    source counts as an empty name and stays null in the result; a null text has no tokens by the estimate. No leaf gets
    more than its budget; a leaf of which no document fits gets none. A name that isn't in ``weights`` weighs 1, a weight
    of 0 gets nothing. Equal rows are used separately. Columns of ``docs`` named domain, tokens or epoch, in any case, are
    replaced, all others stay; an empty table gives an empty one.
    """
    text = {x: F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("lang", "source")}
    counted = tokens(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    keyed = carried(
        docs, ["domain", "tokens", "epoch"], domain=default_domain(text["source"]) if domain is None else domain, lang=text["lang"], source=text["source"],
        tokens=counted, doc=F.col("doc_id"), text=F.coalesce("text", F.lit("")),
    )
    leaf = list(LEVELS)
    leaves = written(keyed.groupBy(*leaf).agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("rows")), "leaves")
    given = leaf_budgets(leaves.drop("rows"), weights, budget_share, max_epochs)
    whole = F.expr("coalesce(given div nullif(held, 0), 0)")
    budgets = written(given.join(leaves.drop("held"), leaf).select(*leaf, whole.cast("int").alias("epochs"), (F.col("given") - whole * F.col("held")).alias("rest"), "rows"), "budgets")
    # the place of a row in the epoch that its leaf uses in part
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "epochs", "doc", F.md5("text")))
    ordered = beside(keyed, budgets, leaf).withColumn("at", F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")).drop("text")
    cuts = cuts_of(ordered.drop("row"), leaf)
    part = F.shiftright("at", HASH_BITS - 2 * (RANGES - 1).bit_length())
    placed = beside(ordered, cuts, leaf).withColumn("last", F.col("over") & (part == F.col("cut")))
    sure = placed.where(~F.col("last")).withColumn("more", F.when(~F.col("over") | (part < F.col("cut")), 1).otherwise(0))
    running = W.partitionBy(*leaf).orderBy("at", "doc", "tokens").rowsBetween(W.unboundedPreceding, 0)
    edge = placed.where("last").withColumn("more", F.when(F.col("before") + F.sum("tokens").over(running) <= F.col("rest"), 1).otherwise(0))
    used = sure.unionByName(edge).withColumn("uses", F.col("epochs") + F.col("more")).where(F.col("uses") > 0)
    return used.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("uses") - 1))).select("row.*", "domain", "tokens", "epoch")


def op4_budget_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "domain", "lang", "source", "tokens", "epoch")

"""Costs, failures and judgments, from the events and embeddings tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.folds import running_totals
from ..sources.items import SOURCES
from .registry import registry

Q, SQL, query = registry()


#: Prices a token of some models (prompt, completion), and of all others.
PRICES = {
    "signup": (0.00000027, 0.000001), "click": (0.0000003, 0.0000025), "purchase": (0.000003, 0.000015), "error": (0.0000025, 0.00001),
}
OTHER = (0.0000005, 0.0000015)


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost events: the type of an event stands for the model, its user for the item and the task."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    prices = F.broadcast(spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, prompt_price double, completion_price double"))
    u = e.select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("model"), F.concat(F.lit("t"), F.col("user_id") % 5).alias("task"), F.col("user_id").alias("item"),
        F.floor(F.col("value") * 100).cast("long").alias("prompt_tokens"), F.floor(F.col("value") * 10).cast("long").alias("completion_tokens"),
    )
    p = lambda c, i: F.coalesce(F.col(c), F.lit(OTHER[i]))
    cost = F.col("prompt_tokens") * p("prompt_price", 0) + F.col("completion_tokens") * p("completion_price", 1)
    return u.join(prices, "model", "left").select(*u.columns, cost.alias("cost"))


_P = ", ".join(f"('{m}', {a:.12f}::DOUBLE, {b:.12f}::DOUBLE)" for m, (a, b) in PRICES.items())
PRICED = f"""prices(model, pp, cp) AS (VALUES {_P}),
priced AS (
    SELECT event_id, ts, event_type AS model, 't' || (user_id % 5) AS task, user_id AS item, floor(value * 100)::BIGINT AS prompt_tokens, floor(value * 10)::BIGINT AS completion_tokens,
        floor(value * 100)::BIGINT * coalesce(pp, {OTHER[0]:.12f}::DOUBLE) + floor(value * 10)::BIGINT * coalesce(cp, {OTHER[1]:.12f}::DOUBLE) AS cost
    FROM events LEFT JOIN prices ON model = event_type
)"""


def dollars(c: Column) -> Column:
    return F.round(F.sum(c), 6)


@query(
    "cost_grouping_sets_A10",
    f"""WITH {PRICED} SELECT model, task, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, round(sum(cost), 6) AS cost, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens
    FROM priced GROUP BY GROUPING SETS ((model), (task), (model, task), (strftime(ts, '%Y-%m-%d')), ())""",
)
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = priced(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    m, t, d = F.col("model"), F.col("task"), F.col("day")
    sums = [F.count(F.lit(1)).alias("calls"), dollars(F.col("cost")).alias("cost"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")]
    return p.groupingSets([[m], [t], [m, t], [d], []], m, t, d).agg(*sums)


@query("cost_by_hour_A11", f"WITH {PRICED} SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS calls, round(avg(cost), 9) AS mean_cost FROM priced GROUP BY 1")
def by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg("cost"), 9).alias("mean_cost"))


@query("cost_topk_O5", f"WITH {PRICED} SELECT item, round(sum(cost), 6) AS cost, count(*) AS calls FROM priced GROUP BY item ORDER BY round(sum(cost), 6) DESC, item LIMIT 15")
def dearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).groupBy("item").agg(dollars(F.col("cost")).alias("cost"), F.count(F.lit(1)).alias("calls")).orderBy(F.col("cost").desc(), "item").limit(15)


@query("cost_running_W8", f"WITH {PRICED} SELECT event_id, (sum(prompt_tokens + completion_tokens) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS tokens_so_far FROM priced")
def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = priced(spark, sf_dir).withColumn("tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return running_totals(p, F.date_trunc("hour", "ts"), ["ts", "event_id"], "tokens", "tokens_so_far").select("event_id", "tokens_so_far")


@query(
    "alerts_G21",
    f"""WITH {PRICED}, s AS (SELECT item, sum(cost) AS cost FROM priced GROUP BY item)
    SELECT item, CASE WHEN cost > 1 THEN 'critical' WHEN cost > 0.8 THEN 'warning' WHEN cost > 0.01 THEN 'item' END AS alert, round(cost, 6) AS cost FROM s WHERE cost > 0.01""",
)
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = priced(spark, sf_dir).groupBy("item").agg(F.sum("cost").alias("c")).where(F.col("c") > 0.01)
    return s.select("item", F.when(F.col("c") > 1, "critical").when(F.col("c") > 0.8, "warning").otherwise("item").alias("alert"), F.round("c", 6).alias("cost"))


@query(
    "failure_runs_W6",
    """WITH f AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
    runs AS (SELECT user_id, island, count(*) AS length, min(event_id) AS first_event FROM f WHERE bad GROUP BY ALL) SELECT user_id, length, first_event FROM runs WHERE length >= 2""",
)
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("bad", F.col("event_type") == "error")
    told = e.select("user_id", "ts", "event_id", "bad", (~F.col("bad")).cast("long").alias("good"))
    # a run is known by the good events before it, counted hour by hour: a user of very many events is many tasks
    islands = running_totals(told, F.date_trunc("hour", F.col("ts")), ["ts", "event_id"], "good", "island", ["user_id"])
    runs = islands.where("bad").groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("length"), F.min("event_id").alias("first_event"))
    return runs.where(F.col("length") >= 2).select("user_id", "length", "first_event")


@query(
    "degraded_A23",
    """SELECT user_id % 50 AS step, count(*) AS attempts, count(*) FILTER (WHERE event_type = 'error') AS failed, floor(100.0::DOUBLE * count(*) FILTER (WHERE event_type = 'error') / count(*) + 0.5)::BIGINT AS percent
    FROM events GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (WHERE event_type = 'error') * 5 >= count(*)""",
)
def degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    g = e.groupBy((F.col("user_id") % 50).alias("step")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("event_type") == "error").alias("failed"))
    g = g.where((F.col("attempts") >= 5) & (F.col("failed") * 5 >= F.col("attempts")))
    return g.withColumn("percent", F.floor(100.0 * F.col("failed") / F.col("attempts") + 0.5))


#: Weights of the judges.
JUDGES = {"archivist": 0.42, "investigator": 0.22, "ontologist": 0.36}
MODELS = 4

_SCORES = f"""scores AS (
    SELECT v.vec_id AS item, m.model, j.judge, j.weight, ((v.label + 1) * (m.n + 2) + v.vec_id * j.k) % 11 AS score
    FROM embeddings v, (SELECT 'model-' || r AS model, r AS n FROM range({MODELS}) t(r)) m, (VALUES {", ".join(f"('{j}', {w}::DOUBLE, {3 + 2 * i})" for i, (j, w) in enumerate(JUDGES.items()))}) j(judge, weight, k)
)"""


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, model, judge, weight, score: each judge's score of each model's work on each item."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item"), F.col("label").cast("long").alias("label"))
    seats = [(f"model-{n}", n, j, w, 3 + 2 * i) for n in range(MODELS) for i, (j, w) in enumerate(JUDGES.items())]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(n).alias("n"), F.lit(j).alias("judge"), F.lit(w).alias("weight"), F.lit(k).alias("k")) for m, n, j, w, k in seats]))
    rows = v.withColumn("s", each)
    return rows.select("item", "s.model", "s.judge", "s.weight", (((F.col("label") + 1) * (F.col("s.n") + 2) + F.col("item") * F.col("s.k")) % 11).alias("score"))


@query(
    "council_consensus_A18",
    f"""WITH {_SCORES}, wins AS (SELECT item, judge, model AS winner FROM (SELECT *, row_number() OVER (PARTITION BY item, judge ORDER BY score DESC, model) AS k FROM scores) WHERE k = 1),
    sums AS (SELECT s.item, s.model, round(sum(score * weight), 3) AS score, round(avg(score), 3) AS mean, count(w.winner) AS judge_wins FROM scores s LEFT JOIN wins w ON w.item = s.item AND w.judge = s.judge AND w.winner = s.model GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, judge_wins DESC, mean DESC, model) AS k FROM sums)
    SELECT b.item, b.model AS winner, b.score, b.judge_wins, (SELECT count(DISTINCT winner) - 1 FROM wins w WHERE w.item = b.item) AS disagreement FROM best b WHERE k = 1""",
)
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = judgments(spark, sf_dir)
    wins = s.groupBy("item", "judge").agg(F.min_by("model", F.struct(-F.col("score"), "model")).alias("model")).withColumn("win", F.lit(1))
    sums = s.join(wins, ["item", "judge", "model"], "left").groupBy("item", "model").agg(
        F.round(F.sum(F.col("score") * F.col("weight")), 3).alias("score"), F.round(F.avg("score"), 3).alias("mean"), F.count("win").alias("judge_wins")
    )
    best = sums.groupBy("item").agg(F.min(F.struct(-F.col("score"), -F.col("judge_wins"), -F.col("mean"), "model", "score", "judge_wins")).alias("b"))
    split = wins.groupBy("item").agg((F.count_distinct("model") - 1).alias("disagreement"))
    return best.join(split, "item").select("item", F.col("b.model").alias("winner"), F.col("b.score").alias("score"), F.col("b.judge_wins").alias("judge_wins"), "disagreement")


@query("council_pivot_A19", f"WITH {_SCORES} SELECT model, " + ", ".join(f"round(avg(score) FILTER (WHERE judge = '{j}'), 6) AS {j}" for j in JUDGES) + ", count(*) AS n FROM scores GROUP BY model")
def council(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = judgments(spark, sf_dir)
    mean = [F.round(F.avg(F.when(F.col("judge") == j, F.col("score"))), 6).alias(j) for j in JUDGES]
    return s.groupBy("model").agg(*mean, F.count(F.lit(1)).alias("n"))


_SOURCE_OF = "list_extract(['pinboard', 'github', 'mastodon', 'arena'], (item % 4 + 1)::INTEGER)"


@query(
    "cost_leaderboard_A10_G20",
    f"""WITH {PRICED}, p AS (SELECT *, {_SOURCE_OF} AS source, strftime(ts, '%Y-%m-%d') AS day FROM priced)
    SELECT model, task, item, source, day, grouping(model, task, item, source, day)::BIGINT AS level, count(*) AS calls, round(sum(cost), 8) AS cost, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens, count(DISTINCT task) AS tasks
    FROM p GROUP BY GROUPING SETS ((model), (task), (task, model), (item, source), (source), (day), (day, model), (day, task), ())""",
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by model, task, both, item, source and day in one pass; ``level`` says which of the five are summed over."""
    names = F.array(*[F.lit(s) for s in SOURCES])
    p = priced(spark, sf_dir).withColumns({"source": F.try_element_at(names, (F.col("item") % 4 + 1).cast("int")), "day": F.date_format("ts", "yyyy-MM-dd"), "work": F.col("task")})
    m, t, i, s, d = (F.col(c) for c in ("model", "task", "item", "source", "day"))
    sums = [F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 8).alias("cost"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.size(F.collect_set("work")).cast("long").alias("tasks")]
    return p.groupingSets([[m], [t], [t, m], [i, s], [s], [d], [d, m], [d, t], []], m, t, i, s, d).agg(F.grouping_id("model", "task", "item", "source", "day").alias("level"), *sums)


#: Dollars that a session may cost, the share of them from which on there is a warning, and those of an item.
SESSION_LIMIT, WARNING_SHARE, ITEM_LIMIT = 1.0, 0.8, 0.1


@query(
    "session_alerts_G21",
    f"""WITH {PRICED}, s AS (SELECT task || '-' || strftime(ts, '%Y-%m-%d') AS session, item, sum(cost) * 100 AS cost FROM priced GROUP BY GROUPING SETS ((task || '-' || strftime(ts, '%Y-%m-%d')), (task || '-' || strftime(ts, '%Y-%m-%d'), item))),
    a AS (SELECT session, item, cost, CASE WHEN item IS NOT NULL THEN CASE WHEN cost > {ITEM_LIMIT} THEN 'item' END WHEN cost > {SESSION_LIMIT} THEN 'critical' WHEN cost > {SESSION_LIMIT * WARNING_SHARE} THEN 'warning' END AS alert FROM s)
    SELECT session, item, alert, round(cost, 6) AS cost FROM a WHERE alert IS NOT NULL""",
)
def session_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions (a task's day) and their items that cost too much. The test tables' calls are cheap: they count a hundredfold."""
    p = priced(spark, sf_dir).withColumn("session", F.concat("task", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")))
    s = p.groupingSets([[F.col("session")], [F.col("session"), F.col("item")]], F.col("session"), F.col("item")).agg(F.grouping("item").alias("whole"), (F.sum("cost") * 100).alias("c"))
    session = F.when(F.col("c") > SESSION_LIMIT, "critical").when(F.col("c") > SESSION_LIMIT * WARNING_SHARE, "warning")
    alert = F.when(F.col("whole") == 1, session).when(F.col("c") > ITEM_LIMIT, "item")
    return s.select("session", "item", alert.alias("alert"), F.round("c", 6).alias("cost")).where(F.col("alert").isNotNull())


#: Scores from which on a judge names an edge as good, and up to which as bad.
GOOD, BAD = 8, 2


@query(
    "council_aggregate_A19_G23",
    f"""WITH {_SCORES}, wins AS (SELECT item, judge, model FROM (SELECT *, row_number() OVER (PARTITION BY item, judge ORDER BY score DESC, model) AS k FROM scores) WHERE k = 1),
    sums AS (SELECT s.item, s.model, round(sum(score * weight), 3) AS score, round(avg(score), 3) AS mean, count(w.model) AS judge_wins FROM scores s LEFT JOIN wins w ON w.item = s.item AND w.judge = s.judge AND w.model = s.model GROUP BY ALL),
    best AS (SELECT model, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, judge_wins DESC, mean DESC, model) AS k FROM sums) WHERE k = 1 GROUP BY model),
    m AS (SELECT 'model-' || r AS model, r AS n FROM range({MODELS}) t(r)),
    rels AS (SELECT m.model, sum((v.vec_id + m.n) % 4)::BIGINT AS relationships, sum(len(list_filter(range((v.vec_id + m.n) % 4), lambda k: (v.vec_id + k) % 3 = 0)))::BIGINT AS reported FROM embeddings v, m GROUP BY m.model)
    SELECT s.model, coalesce(max(b.wins), 0) AS wins, (SELECT round(avg(x.score), 3) FROM sums x WHERE x.model = s.model) AS average_score, """
    + ", ".join(f"round(avg(s.score) FILTER (WHERE s.judge = '{j}'), 3) AS {j}_average, (SELECT count(*) FROM wins w WHERE w.judge = '{j}' AND w.model = s.model) AS {j}_wins" for j in JUDGES)
    + f""", count(*) FILTER (WHERE s.score >= {GOOD}) AS good_edge_mentions, count(*) FILTER (WHERE s.score <= {BAD}) AS bad_edge_mentions,
        max(r.relationships) AS relationships, max(r.reported) AS reported, max(r.relationships - r.reported) AS asserted
    FROM scores s LEFT JOIN best b ON b.model = s.model JOIN rels r ON r.model = s.model GROUP BY s.model""",
)
def council_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each model how often it wins, what judges give it, the edges they name, and its relationships by how they are claimed.

    An item's judgments (models times judges of them) meet in one row, so that one shuffle by item serves all figures.
    """
    s = judgments(spark, sf_dir).groupBy("item").agg(F.collect_list(F.struct("judge", "model", "score", "weight")).alias("all"))
    models = [f"model-{n}" for n in range(MODELS)]
    of = lambda key, value: F.filter("all", lambda x: x[key] == value)
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))
    # each judge's winner: the greatest score, of equals the least name
    won = s.withColumns({f"{j}_winner": F.array_min(F.transform(of("judge", j), lambda x: F.struct((-x["score"]).alias("less"), x["model"].alias("model"))))["model"] for j in JUDGES})
    won = won.withColumn("winners", F.array(*[f"{j}_winner" for j in JUDGES]))
    one = lambda m: F.struct(
        (-F.round(total(of("model", m), lambda x: x["score"] * x["weight"]), 3)).alias("less"), (-F.size(F.filter("winners", lambda w: w == m))).alias("fewer"),
        (-F.round(total(of("model", m), lambda x: x["score"].cast("double")) / F.size(of("model", m)), 3)).alias("lower"), F.lit(m).alias("model"),
    )
    ranked = won.withColumn("ranked", F.array_sort(F.array(*[one(m) for m in models]))).withColumn("winner", F.col("ranked")[0]["model"])
    made = lambda x: (F.col("item") + F.substring(x["model"], 7, 9).cast("long")) % 4
    each = ranked.select("item", "all", "winner", *[f"{j}_winner" for j in JUDGES], F.explode("ranked").alias("r"))
    own, m = F.filter("all", lambda x: x["model"] == F.col("r.model")), F.col("r.model")
    by = lambda j: F.filter(own, lambda x: x["judge"] == j)
    n_rel = made(F.col("r"))
    reported = F.size(F.filter(F.array(*[F.lit(k) for k in range(3)]), lambda k: (k < n_rel) & ((F.col("item") + k) % 3 == 0)))
    per = each.select(
        m.alias("model"), (-F.col("r.less")).alias("score"), (F.col("winner") == m).cast("long").alias("win"),
        *[(F.col(f"{j}_winner") == m).cast("long").alias(f"{j}_win") for j in JUDGES], *[by(j)[0]["score"].alias(f"{j}_score") for j in JUDGES],
        F.size(F.filter(own, lambda x: x["score"] >= GOOD)).alias("good"), F.size(F.filter(own, lambda x: x["score"] <= BAD)).alias("bad"), n_rel.alias("rels"), reported.alias("reported"),
    )
    judged = [c for j in JUDGES for c in (F.round(F.avg(f"{j}_score"), 3).alias(f"{j}_average"), F.sum(f"{j}_win").alias(f"{j}_wins"))]
    return per.groupBy("model").agg(
        F.sum("win").alias("wins"), F.round(F.avg("score"), 3).alias("average_score"), *judged, F.sum("good").alias("good_edge_mentions"), F.sum("bad").alias("bad_edge_mentions"),
        F.sum("rels").alias("relationships"), F.sum("reported").alias("reported"), F.sum(F.col("rels") - F.col("reported")).alias("asserted"),
    )

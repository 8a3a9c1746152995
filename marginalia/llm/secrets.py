"""Secret scans: known forms, and strings that pass a battery of randomness tests.

Three known forms are always spans. Beyond them, every long run of key characters that they leave over is a candidate.
Its encoding is inferred, and a battery asks whether it may have been drawn at random from that alphabet: chi-squared for
uniformity, the number of runs above and below the middle of the alphabet, and serial correlation. Critical values come
from simulated random strings of the same encoding and length, at a third of LEVEL each, so that the battery turns away
at most LEVEL of all random strings however the three tests depend on each other.

That says nothing yet of natural strings that pass by chance. So each candidate that passes has an e-value: its
likelihood as a random string over that under the natural law of letters, signs and digits that explains it best
(a string that fails the battery has 0). Under any of these laws its mean is at most 1, and grows with the length only
for random strings. The step-up rule for e-values (Wang and Ramdas, 2022), which holds under any dependence, then reports
candidates of each encoding and length class so that of the reported ones at most a share RATE is expected to be natural.
The rule works on counts of e-values in classes, a table whose size doesn't depend on the corpus.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import carried, let, written

#: Fixed values of the contract: the three known forms, and the least length of what must be that long.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: Candidates: runs of key characters of at least this length; a span must not begin or end within one.
LEAST_RANDOM = 20
RUN = r"[A-Za-z0-9+/_-]{%d,}" % LEAST_RANDOM
#: Symbols of each encoding, in the order of their values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: The share of random strings that the battery may turn away, and of natural ones among those reported.
LEVEL, RATE = 0.01, 0.01
#: Logarithms of e-values are counted in classes of 1 / CLASSES up to LAST_CLASS / CLASSES; 0: no evidence.
CLASSES, LAST_CLASS = 4, 400
#: Strings that are simulated for each encoding and length, and the greatest length; longer ones use its values.
SIMULATED, LONGEST, SEED = 4000, 128, 7

#: Thousandths of the letters a to z in the natural text of several languages, rounded.
LETTERS = (80, 13, 31, 42, 140, 13, 15, 33, 72, 3, 8, 46, 27, 73, 60, 24, 5, 66, 69, 72, 42, 13, 10, 2, 9, 5)
#: Natural laws of strings: the shares of lower-case letters, capitals, digits and other signs.
NATURAL = {"words": (88, 4, 4, 4), "names": (66, 18, 8, 8), "constants": (4, 82, 8, 6), "numbers": (7, 5, 82, 6), "paths": (62, 6, 20, 12)}
#: The same for hexadecimal strings, of digits and letters.
NATURAL_HEX = {"words": (85, 15), "numbers": (8, 92)}

SPANS = "array<struct<start:int,rank:int,end:int>>"


def found(text: Column, pattern: str, rank: int, keep: Column | None = None) -> Column:
    """The leftmost non-overlapping matches as (start, rank, end) in code points: gaps and matches add up to the text.

    ``keep``: an array of booleans, one for each match.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("all"))
    ends = lambda acc, x: acc["at"] + x["g"] + x["m"]
    spans = F.aggregate(
        F.arrays_zip(F.transform(matches, F.length).alias("m"), gaps.alias("g")),
        start,
        lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(
            F.struct(ends(acc, x).alias("at"), F.concat(acc["all"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), F.lit(rank).alias("rank"), ends(acc, x).alias("end")))).alias("all"))
        ),
    )["all"]
    if keep is not None:
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("s"), keep.alias("k")), lambda x: x["k"]), lambda x: x["s"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS))


def known(text: Column) -> Column:
    """Spans of the known forms by start, then kind."""
    long = lambda pattern, group, least: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x) >= least)
    return F.sort_array(
        F.concat(
            found(text, ASSIGN, 0, long(ASSIGN, 2, LEAST_ASSIGN)),
            # as maximal runs, these hold the same matches as the open forms that pass their least length
            found(text, r"AKIA[A-Z0-9]{%d,}" % (LEAST_ACCESS - 4), 1),
            found(text, r"[0-9a-f]{%d,}" % LEAST_HEX, 2),
        )
    )


def encoding(s: Column) -> Column:
    return (
        F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.when(s.rlike("^[0-9]+$"), F.lit("digits")).otherwise(F.lit("hex")))
        .when(s.rlike("^[A-Z2-7]+$"), F.lit("base32"))
        .otherwise(F.lit("base64"))
    )


def _values(s: Column, code: Column) -> Column:
    """The value of each symbol in its encoding."""
    plain = F.when(code == "hex", F.lower(s)).otherwise(F.translate(s, "-_", "+/"))
    alphabet = F.when(code == "hex", ALPHABETS["hex"]).when(code == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
    return F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))


def log_laws(code: str) -> list[list[float]]:
    """For each natural law of an encoding the logarithm of each symbol's probability over that of a random one."""
    alphabet = ALPHABETS[code]
    weight = {c: w for c, w in zip("abcdefghijklmnopqrstuvwxyz", LETTERS)}
    shares = [(low + up, 0, digits + signs, 0) for low, up, digits, signs in NATURAL.values()] if code == "base32" else NATURAL.values()
    shares = [(letters, 0, digits, 0) for letters, digits in NATURAL_HEX.values()] if code == "hex" else shares
    kind = lambda c: 2 if c.isdigit() else 3 if not c.isalpha() else 1 if c.isupper() and code == "base64" else 0
    own = [weight.get(c.lower(), 1) for c in alphabet]
    whole = [sum(w for c, w in zip(alphabet, own) if kind(c) == k) for k in range(4)]
    total = lambda law: sum(x for k, x in enumerate(law) if whole[k])
    return [[float(np.log(len(alphabet) * law[kind(c)] / total(law) * w / whole[kind(c)])) for c, w in zip(alphabet, own)] for law in shares]


def statistics(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chi-squared, runs and serial statistics of each row of symbols, as ``_passes`` computes them."""
    n = v.shape[1]
    counts = np.bincount((np.arange(len(v))[:, None] * k + v).ravel(), minlength=len(v) * k).reshape(len(v), k)
    squares = (counts.astype(float) ** 2).sum(1)
    high = v >= k / 2
    upper, changes = high.sum(1).astype(float), (high[:, 1:] != high[:, :-1]).sum(1)
    middle = 2 * upper * (n - upper) / n
    spread = middle * (middle - 1) / (n - 1)
    runs = np.where(spread > 0, np.abs(changes - middle) / np.sqrt(np.maximum(spread, 1e-9)), np.sqrt(n))
    d = v - v.mean(1, keepdims=True)
    variance = (d * d).sum(1)
    serial = np.where(variance > 0, np.abs((d[:, 1:] * d[:, :-1]).sum(1)) / np.maximum(variance, 1e-9) * np.sqrt(n), np.sqrt(n))
    return (k / n * squares - n - (k - 1)) / np.sqrt(2 * (k - 1) * (1 - 1 / n)), runs, serial


@lru_cache(maxsize=None)
def critical(code: str, n: int) -> tuple[float, float, float]:
    """The values that random strings of ``n`` symbols pass in a third of LEVEL of all cases at most."""
    k = len(ALPHABETS[code])
    v = np.random.default_rng([SEED, k, n]).integers(0, k, (SIMULATED, n))
    return tuple(float(np.sort(x)[int(np.ceil(SIMULATED * (1 - LEVEL / 3)))]) for x in statistics(v, k))


def _criticals(code: Column, n: Column) -> Column:
    """array<double> of the three critical values."""
    out = None
    for name in ALPHABETS:
        table = F.array(*[F.array(*map(F.lit, critical(name, i))) for i in range(LEAST_RANDOM, LONGEST + 1)])
        own = F.get(table, F.least(n, F.lit(LONGEST)) - LEAST_RANDOM)
        out = F.when(code == name, own) if out is None else out.when(code == name, own)
    return out


def _passes(t: Column, k: Column, limits: Column) -> Column:
    """Whether a string of the sums ``t`` is one that may have been drawn at random."""
    n, upper = t["n"], t["upper"]
    chi = (k / n * t["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
    middle = 2 * upper * (n - upper) / n
    spread = middle * (middle - 1) / (n - 1)
    runs = F.when(spread > 0, F.abs(t["changes"] - middle) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.sqrt(n))
    serial = F.when(t["variance"] > 0, F.abs(t["lag"]) / F.greatest(t["variance"], F.lit(1e-9)) * F.sqrt(n)).otherwise(F.sqrt(n))
    return (chi <= limits[0] + 1e-9) & (runs <= limits[1] + 1e-9) & (serial <= limits[2] + 1e-9)


def _log_e(v: Column, code: Column) -> Column:
    """The logarithm of the likelihood of symbols as random ones over that under the natural law that explains them best."""

    def under(law: list[float]) -> Column:
        each = F.array(*map(F.lit, law))
        return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.get(each, x.cast("int")))

    sums = lambda name: F.greatest(*map(under, log_laws(name)))
    return -F.when(code == "hex", sums("hex")).when(code == "base32", sums("base32")).otherwise(sums("base64"))


def judged(s: Column, code: Column) -> Column:
    """struct<passes, e_class>: whether the battery lets ``s`` pass as random, and the class of its e-value (0 if not)."""
    k = F.when(code == "hex", 16.0).when(code == "base32", 32.0).otherwise(64.0)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    def of(v: Column) -> Column:
        """The sums that the tests need, each computed once."""
        return let(
            F.struct(v.alias("v"), F.size(v).cast("double").alias("n"), (total(v) / F.size(v)).alias("mean"), F.sequence(F.lit(1), F.size(v) - 1).alias("pairs")),
            lambda x: let(
                F.struct(
                    x["n"].alias("n"),
                    total(F.transform(F.array_distinct(x["v"]), lambda d: let(F.size(F.filter(x["v"], lambda o: o == d)).cast("double"), lambda o: o * o))).alias("squares"),
                    total(F.transform(x["v"], lambda o: F.when(o >= k / 2, 1.0).otherwise(0.0))).alias("upper"),
                    total(F.transform(x["pairs"], lambda i: F.when((F.get(x["v"], i) >= k / 2) != (F.get(x["v"], i - 1) >= k / 2), 1.0).otherwise(0.0))).alias("changes"),
                    total(F.transform(x["v"], lambda o: (o - x["mean"]) * (o - x["mean"]))).alias("variance"),
                    total(F.transform(x["pairs"], lambda i: (F.get(x["v"], i) - x["mean"]) * (F.get(x["v"], i - 1) - x["mean"]))).alias("lag"),
                ),
                lambda t: let(
                    _passes(t, k, _criticals(code, x["n"].cast("int"))),
                    lambda ok: F.struct(
                        ok.alias("passes"),
                        F.when(ok, F.greatest(F.lit(0), F.least(F.lit(LAST_CLASS), F.floor(F.round(_log_e(x["v"], code) * CLASSES, 6)).cast("int")))).otherwise(0).alias("e_class"),
                    ),
                ),
            ),
        )

    return let(_values(s, code), of)


def candidates(text: Column, spans: Column) -> Column:
    """array<struct<start, end, code, length_class, passes, e_class>> of the long parts of runs that ``spans``, sorted, leave over."""
    touching = lambda r: F.filter(spans, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"]))
    part = lambda a, b: F.struct(a.alias("start"), F.lit(3).alias("rank"), b.alias("end"))

    def left(r: Column) -> Column:
        start = F.struct(r["start"].alias("at"), F.array().cast(SPANS).alias("all"))
        return F.aggregate(
            touching(r),
            start,
            lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["all"], F.array(part(acc["at"], s["start"]))).alias("all")),
            lambda acc: F.concat(acc["all"], F.array(part(acc["at"], r["end"]))),
        )

    long = lambda r: r["end"] - r["start"] >= LEAST_RANDOM
    whole = lambda r: ~F.exists(spans, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"]))
    runs = F.filter(F.flatten(F.transform(found(text, RUN, 3), lambda r: F.when(whole(r), F.array(r)).otherwise(left(r)))), long)
    return _tested(text, runs)


def _tested(text: Column, parts: Column) -> Column:
    """The verdicts on ``parts`` of a text; those of digits alone are left out, as no alphabet has them for its own."""

    def tested(r: Column) -> Column:
        s = F.substring(text, r["start"] + 1, r["end"] - r["start"])
        return let(
            F.struct(s.alias("s"), encoding(s).alias("code")),
            lambda x: let(
                judged(x["s"], x["code"]),
                lambda v: F.struct(
                    r["start"].alias("start"), r["end"].alias("end"), x["code"].alias("code"), F.floor(F.log2(F.length(x["s"]))).cast("int").alias("length_class"),
                    v["passes"].alias("passes"), v["e_class"].alias("e_class"),
                ),
            ),
        )

    digits = lambda r: F.substring(text, r["start"] + 1, r["end"] - r["start"]).rlike("^[0-9]+$")
    return F.transform(F.filter(parts, lambda r: ~digits(r)), tested)


def values(text: Column, spans: Column) -> Column:
    """The last run of key characters of each known span that is long enough to be tested: what it holds secret."""
    n = lambda s: F.length(F.regexp_extract(F.substring(text, s["start"] + 1, s["end"] - s["start"]), "[A-Za-z0-9+/_-]+$", 0))
    last = F.transform(spans, lambda s: F.struct((s["end"] - n(s)).alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return F.filter(last, lambda s: s["end"] - s["start"] >= LEAST_RANDOM)


def reported_from(tested: DataFrame, rate: float = RATE) -> dict[tuple[str, int], int]:
    """(encoding, length class) -> the e_class from which candidates are reported; ``tested``: rows of verdicts.

    The step-up rule for e-values: the least class c whose e-values, taken at the class's low end, are at least
    m / (rate * candidates of class c or beyond), of m candidates. One row for each encoding and length class (they
    number 3 and at most 31) comes to the driver.
    """
    by = ["code", "length_class"]
    counted = tested.groupBy(*by, "e_class").agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(*by)
    beyond = F.sum("n").over(whole.orderBy(F.col("e_class").desc()).rowsBetween(W.unboundedPreceding, 0))
    stepped = counted.withColumns({"m": F.sum("n").over(whole), "beyond": beyond})
    passed = stepped.where((F.col("e_class") > 0) & (F.exp(F.col("e_class") / F.lit(float(CLASSES))) * F.lit(rate) * F.col("beyond") >= F.col("m")))
    return {(r["code"], r["length_class"]): r["c"] for r in passed.groupBy(*by).agg(F.min("e_class").alias("c")).collect()}


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` with spans: array<struct<start, rank, end>> by start, then kind (``rank`` counts in KINDS), n_base, and
    n_tested and n_passed: of how many known spans the value is long enough for the battery, and passes it.

    Offsets are code points, ends are exclusive. A null text counts as an empty one and has no spans; equal texts have
    equal spans. Columns of ``docs`` of these names are replaced, all others stay. An empty table gives an empty one.
    Each text is read once: what is found in it is written beside it, and the rule's limits are looked up afterwards.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found_in = let(known(text), lambda base: F.struct(base.alias("base"), candidates(text, base).alias("tested"), _tested(text, values(text, base)).alias("values")))
    based = written(carried(docs, ["spans", "n_base", "n_tested", "n_passed"], found=found_in), "scanned")
    limits = reported_from(based.select(F.inline("found.tested")), rate)
    own = F.create_map(*[F.lit(x) for (code, k), c in limits.items() for x in (f"{code}{k}", c)]) if limits else F.create_map().cast("map<string,int>")
    keep = lambda t: t["e_class"] >= F.coalesce(F.try_element_at(own, F.concat(t["code"], t["length_class"].cast("string"))), F.lit(LAST_CLASS + 1))
    added = F.transform(F.filter("found.tested", keep), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end")))
    made = based.select(
        "row", F.sort_array(F.concat("found.base", added)).alias("spans"), F.size("found.base").alias("n_base"), F.size("found.values").alias("n_tested"),
        F.size(F.filter("found.values", lambda v: v["passes"])).alias("n_passed"),
    )
    return made.select("row.*", "spans", "n_base", "n_tested", "n_passed")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with a mask in place of each span (of overlapping ones together); a null text stays null."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(
        spans,
        start,
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] < acc["at"], acc["out"])
                .otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
                .alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _digest(spans: Column) -> Column:
    kind = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    number = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return scan(docs).select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_digest(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"),
        F.col("n_tested").alias("n_base_tested"), F.col("n_passed").alias("n_base_random"),
    )

"""Secret scans: fixed patterns, and a randomness test battery for what no pattern names.

Runs of characters that encodings use are candidates. The encoding of a run is inferred
from its alphabet; a run that fits none (KEY=value, parameters, paths) is cut at its inner
'=', and what still fits none at '/' and at '-' or '_', each in its own right and then both.
All parts of ``RUN_CHARS`` characters are candidates. Three tests then ask whether it was drawn at random from it: a
chi-squared test of uniform use, a runs test about the middle of the alphabet, and the
serial correlation of neighbours. Their p-values are joined by Fisher's method, and a run
for which randomness is rejected is no secret.

Of the others, the index of coincidence gives the p-value of "this is a word of prose":
the chance that prose of that length keeps to the alphabet and uses it as evenly. These
p-values pass the Benjamini-Hochberg procedure in bands of length, each band with its own
number of tests, so short runs, which are many and tell little, meet a stricter bound.
Ranks come from counts per tenth of a decade, so no band is sorted in one task.

All is done with DataFrame functions. Positions are code points; they follow from the
lengths of what stands between the matches.

Edge cases: null and empty texts have no spans; every row is scanned for itself, repeated
or not; a null ``doc_id`` passes through; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import stored, whole_text

#: The patterns of the base spans, in the order of their kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: A match of ASSIGN counts if its value has so many characters.
ASSIGNED_CHARS = 8
#: Candidates of the battery.
RUN_CHARS = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{RUN_CHARS},}}"
#: Cuts of a run that fits no encoding. Padding at its end stays with the last part.
INNER, BETWEEN_SLASHES, BETWEEN_DASHES, BETWEEN_BOTH = r"[^=]+(?:=+\z)?", r"[^/]+", r"[^_-]+", r"[^/_-]+"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings: pattern, alphabet; how prose behaves within that alphabet: the share of its
#: letters that belong to it, and the sums of squares and cubes of their frequencies.
ENCODINGS = (
    (r"^[0-9a-f]+$", DIGITS + "abcdef", 0.30, 0.27, 0.105),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF", 0.30, 0.27, 0.105),
    (r"^[A-Z2-7]+$", UPPER + "234567", 1.0, 0.066, 0.0055),
    (r"^[A-Z0-9]+$", UPPER + DIGITS, 1.0, 0.066, 0.0055),
    (r"^[a-z0-9]+$", LOWER + DIGITS, 1.0, 0.066, 0.0055),
    (r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 1.0, 0.064, 0.0053),
    (r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 1.0, 0.064, 0.0053),
)
#: Runs that some encoding takes; the others' alphabets are within these two.
FITS = r"^(?:[A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*$"
#: Randomness is rejected below this joint p-value.
REJECTED = 1e-3
#: p-values are ranked by tenths of decades, up to this many.
STEPS = 3000
#: Running sums are made in blocks of so many values.
BLOCK = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def sums_before(values: Column) -> Column:
    """For each place of an array of longs, the sum of the values before it.

    Block sums first, then sums within a block, so long arrays stay cheap.
    """
    def of_blocks(values: Column, sums: Column) -> Column:
        bases = F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda b: total(F.slice(sums, 1, b)))
        return let(bases, lambda bases: F.flatten(F.transform(
            F.sequence(F.lit(0), F.size(sums) - 1),
            lambda b: let(F.slice(values, b * BLOCK + 1, BLOCK), lambda part: F.transform(
                F.sequence(F.lit(1), F.size(part)),
                lambda i: F.get(bases, b) + total(F.slice(part, 1, i - 1)))))))

    blocks = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    return let(
        F.transform(F.sequence(F.lit(0), blocks), lambda b: total(F.slice(values, b * BLOCK + 1, BLOCK))),
        lambda sums: of_blocks(values, sums))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches as array<struct<start, end, value>>."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column, between: Column) -> Column:
        steps = F.zip_with(
            F.slice(between, 1, F.size(found)), found,
            lambda gap, value: (F.length(gap) + F.length(value)).cast("long"))
        return let(sums_before(steps), lambda before: F.transform(
            F.sequence(F.lit(0), F.size(found) - 1),
            lambda i: let(F.get(before, i) + F.length(F.get(between, i)), lambda start: F.struct(
                start.alias("start"), (start + F.length(F.get(found, i))).alias("end"),
                F.get(found, i).alias("value")))))

    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    return F.when(
        F.regexp_like(text, F.lit(pattern)),
        let(found, lambda found: let(between, lambda between: placed(found, between))).cast(kind),
    ).otherwise(F.array().cast(kind))


def base_spans(text: Column) -> dict[str, Column]:
    """array<struct<start, end, value>> of each base kind."""
    assigned = F.filter(
        matches(text, ASSIGN),
        lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 1)) >= ASSIGNED_CHARS)
    return {"assign": assigned, "access": matches(text, ACCESS), "hex": matches(text, HEX)}


def log10_below(z: Column) -> Column:
    """Decimal logarithm of the normal distribution function."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * t * (
        0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    w = z * z
    far = (-w / 2 - F.log(-z * math.sqrt(2 * math.pi)) + F.log(1 - 1 / w + 3 / (w * w))) / math.log(10)
    return F.when(z < -4, far).when(z < 0, F.log10(tail)).otherwise(F.log10(1 - tail))


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * F.pow(F.lit(10.0), log10_below(-F.abs(z))))


def candidates(runs: DataFrame) -> DataFrame:
    """row, start, end, value of what the battery tests: ``runs`` that fit an encoding, and parts of others."""
    fits = F.regexp_like("value", F.lit(FITS))

    def cut(rows: DataFrame, pattern: str) -> DataFrame:
        part = F.col("part")
        return rows.filter(~fits).select("row", "start", F.explode(matches(F.col("value"), pattern)).alias("part")).select(
            "row", (F.col("start") + part["start"]).alias("start"), (F.col("start") + part["end"]).alias("end"),
            part["value"].alias("value")).filter(F.length("value") >= RUN_CHARS)

    inner = stored(cut(runs, INNER), "secret-parts")
    again = [cut(inner, pattern) for pattern in (BETWEEN_SLASHES, BETWEEN_DASHES, BETWEEN_BOTH)]
    parts = inner.union(again[0]).union(again[1]).union(again[2])
    return runs.filter(fits).union(parts.filter(fits).distinct())


def battery(runs: DataFrame) -> DataFrame:
    """``runs`` (value) with the inferred encoding's size ``k``, ``n``, ``p_random`` and ``log_p_prose``.

    Runs of no single encoding are left out; ``candidates`` cuts them before.
    """
    body = F.regexp_replace("value", "=+$", "")
    which = F.lit(None).cast("int")
    for i in reversed(range(len(ENCODINGS))):
        which = F.when(F.regexp_like(body, F.lit(ENCODINGS[i][0])), i).otherwise(which)
    facts = runs.withColumns({"body": body, "which": which}).filter(
        F.col("which").isNotNull() & (F.length("body") >= 3))

    def by_encoding(place: int) -> Column:
        return F.get(F.array(*[F.lit(e[place]) for e in ENCODINGS]), F.col("which"))

    symbols = F.array(*[F.lit(c) for c in UPPER + LOWER + DIGITS + "+/-_"])
    count_of = lambda c: F.length("body") - F.length(F.replace(F.col("body"), c, F.lit("")))
    facts = facts.withColumns({
        "alphabet": by_encoding(1), "share": by_encoding(2), "squares": by_encoding(3), "cubes": by_encoding(4),
    }).select(
        "value", "share", "squares", "cubes", F.length("alphabet").cast("double").alias("k"),
        F.length("body").cast("double").alias("n"),
        F.aggregate(symbols, F.lit(0.0), lambda a, c: a + F.pow(count_of(c).cast("double"), F.lit(2))).alias("same"),
        let(F.col("alphabet"), lambda alphabet: F.transform(
            F.split("body", ""), lambda c: (F.position(c, alphabet) - 1).cast("double"))).alias("x"),
    )
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    facts = facts.withColumn("mean", add(F.col("x")) / F.col("n"))
    facts = facts.withColumns({
        "low": F.transform("x", lambda v: F.when(v < F.col("k") / 2, 1.0).otherwise(0.0)),
        "dev": F.transform("x", lambda v: v - F.col("mean")),
    })
    before = lambda name: F.slice(name, 1, F.size(name) - 1)
    after = lambda name: F.slice(name, 2, F.size(name) - 1)
    facts = facts.withColumns({
        "changes": add(F.zip_with(before("low"), after("low"), lambda a, b: F.abs(a - b))),
        "n1": add(F.col("low")),
        "pairs": add(F.zip_with(before("dev"), after("dev"), lambda a, b: a * b)),
        "spread": add(F.transform("dev", lambda v: v * v)),
    })
    n, k, n1 = F.col("n"), F.col("k"), F.col("n1")
    n2, df = n - n1, k - 1
    chi = k * F.col("same") / n - n
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    product = 2 * n1 * n2
    runs_var = product * (product - n) / (n * n * (n - 1))
    z_runs = F.when(runs_var > 0, (F.col("changes") - product / n) / F.sqrt(runs_var)).otherwise(F.sqrt(n))
    z_serial = F.when(F.col("spread") > 0, F.col("pairs") / F.col("spread") * F.sqrt(n) + 1 / F.sqrt(n)).otherwise(F.sqrt(n))
    floor = F.lit(1e-300)
    logs = (
        log10_below(-z_chi) * math.log(10) + F.log(F.greatest(two_sided(z_runs), floor))
        + F.log(F.greatest(two_sided(z_serial), floor)))
    half = -logs  # half of Fisher's statistic, chi-squared with six degrees of freedom
    coincidence = (F.col("same") - n) / (n * (n - 1))
    q2, q3 = F.col("squares"), F.col("cubes")
    deviation = F.sqrt(4 / n * (q3 - q2 * q2) + 2 * q2 * (1 - q2) / (n * (n - 1)))
    return facts.select(
        "value", "k", "n", (F.exp(-half) * (1 + half + half * half / 2)).alias("p_random"),
        (n * F.log10("share") + log10_below((coincidence - q2) / deviation)).alias("log_p_prose"),
    )


def discoveries(tested: DataFrame, rate: float = 0.01) -> DataFrame:
    """The ``value`` of runs that are random and, at false-discovery ``rate``, no prose."""
    steps = tested.withColumns({
        "band": F.floor(F.log2("n")).cast("int"),
        "step": F.least(F.floor(-10 * F.col("log_p_prose")), F.lit(STEPS)).cast("int"),
        "fit": F.col("p_random") >= REJECTED,
    })
    counts = steps.groupBy("band", "step").agg(
        F.count(F.lit(1)).alias("all"), F.sum(F.col("fit").cast("long")).alias("fit"))
    # Bands are logarithms and steps are bounded, so the counts are few.
    band = Window.partitionBy("band")
    down = band.orderBy(F.desc("step"))
    bounds = counts.withColumns({"m": F.sum("all").over(band), "found": F.sum("fit").over(down)}).filter(
        F.col("found") * rate >= F.col("m") * F.pow(F.lit(10.0), -F.col("step") / 10),
    ).groupBy("band").agg(F.min("step").alias("least"))
    return steps.join(F.broadcast(bounds), "band").filter(
        F.col("fit") & (F.col("step") >= F.col("least"))).select("value")


def scan(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and all: arrays of (start, kind, end)."""
    text = whole_text()
    base = base_spans(text)
    rows = stored(docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        *[spans.alias(kind) for kind, spans in base.items()], matches(text, RUN).alias("runs"),
    ), "secret-spans")
    runs = stored(candidates(
        rows.select("row", F.explode("runs").alias("run")).select("row", "run.*")), "secret-candidates")
    tested = stored(battery(runs.select("value").distinct()), "tested-runs")
    found = runs.join(discoveries(tested, rate), "value").groupBy("row").agg(
        F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("found"))
    known = F.concat(*[_of_kind(F.col(kind), i) for i, kind in enumerate(base)])
    scanned = rows.join(found, "row", "left").withColumn("base", F.array_sort(known))
    within = lambda f, b: (b["start"] <= f["start"]) & (b["end"] >= f["end"])
    new = F.filter(
        F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")),
        lambda f: ~F.exists("base", lambda b: within(f, b)) & ~F.exists("found", lambda b: within(f, b) & (b != f)))
    return scanned.select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in base],
        "base", F.array_sort(F.concat("base", new)).alias("all"))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"], F.lit(kind).alias("kind"), m["end"]))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

"""Secret scan: three fixed patterns, and a randomness test battery with false-discovery control.

Everything is a column expression; nothing is shuffled but one histogram of test results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs are maximal, so the runs of 32 and more are those of the open pattern that pass.
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the battery: runs of 20 and more characters of the usual encodings.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Chance that two characters (three) of ordinary prose are equal, and of a change of character class.
PROSE_PAIR, PROSE_TRIPLE, PROSE_CHANGE = 0.067, 0.0058, 0.06
#: False-discovery level per length class, and level under which a test rejects randomness.
FDR, REJECT = 1e-3, 1e-4
#: Evidence (-log10 p) is counted in steps of this size, up to 300.
STEP = 0.05

_DIGIT, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _located(text: Column, pattern: str, groups: tuple[int, ...] = (0,)) -> Column:
    """Matches as array of struct(start, end, g): code points, end exclusive, g the last group asked for.

    The pieces between matches and the matches themselves add up to the places.
    """
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint"))
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found[0])).alias("gap"), found[0].alias("m"), found[-1].alias("g"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,g:string>>")
    walked = F.aggregate(
        rows,
        F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")),
        lambda acc, r: F.struct(
            (acc["at"] + r["gap"] + F.length(r["m"])).alias("at"),
            F.array_append(
                acc["out"],
                F.struct((acc["at"] + r["gap"]).alias("start"), (acc["at"] + r["gap"] + F.length(r["m"])).alias("end"), r["g"].alias("g")),
            ).alias("out"),
        ),
    )
    return walked["out"]


def _none() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint,g:string>>")


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the three fixed kinds; a cheap search spares most texts the patterns."""
    low = F.lower(text)
    word = F.lit(False)
    for k in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        word = word | F.contains(low, F.lit(k))
    assign = F.filter(_located(text, ASSIGN, (0, 2)), lambda r: F.length(r["g"]) >= 8)
    access = F.filter(_located(text, ACCESS), lambda r: r["end"] - r["start"] >= 16)
    return {
        "assign": F.when(word, assign).otherwise(_none()),
        "access": F.when(F.contains(text, F.lit("AKIA")), access).otherwise(_none()),
        "hex": F.when(text.rlike(HEX), _located(text, HEX)).otherwise(_none()),
    }


def normal_tail(z: Column) -> Column:
    """-log10 of the upper normal tail, by the closed form 0.5 exp(-0.717 z - 0.416 z^2) for z > 0."""
    return F.when(z > 0, (0.717 * z + 0.416 * z * z + 0.6931471805599453) / 2.302585092994046).otherwise(0.0)


def _alphabet(token: Column) -> Column:
    """The encoding a token looks like: its alphabet in order of value."""
    return (
        F.when(token.rlike("^[0-9]+$"), _DIGIT)
        .when(token.rlike("^[0-9a-f]+$"), _DIGIT + "abcdef")
        .when(token.rlike("^[0-9A-F]+$"), _DIGIT + "ABCDEF")
        .when(token.rlike("^[A-Z2-7]+$"), _UPPER + "234567")
        .when(token.rlike("^[a-z]+$"), _LOWER)
        .when(token.rlike("^[A-Za-z]+$"), _UPPER + _LOWER)
        .when(token.rlike("^[A-Za-z0-9]+$"), _UPPER + _LOWER + _DIGIT)
        .otherwise(_UPPER + _LOWER + _DIGIT + "+/_-")
    )


def battery(token: Column) -> Column:
    """struct(evidence, random): -log10 p against prose, and whether no test rejects randomness.

    Against prose speak few equal characters and many changes between digits, capitals and small
    letters, both measured with the spread that a token of this length has. Randomness is tested
    by chi-squared uniformity over the inferred alphabet, the runs above and below its middle,
    and the correlation of neighbours. Padding at the end is not looked at; fewer than two characters give null.
    """
    body = F.regexp_replace(token, "=+$", "")
    chars = F.split(body, "")
    alphabet = _alphabet(body)
    a, n = F.length(alphabet).cast("double"), F.size(chars).cast("double")
    squares = F.aggregate(
        F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter(chars, lambda x: x == c)).cast("double"), F.lit(2.0))
    )
    kinds = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[a-z]"), 2).otherwise(3))
    values = F.transform(chars, lambda c: F.instr(alphabet, c).cast("double") - (a + 1) / 2)

    def neighbours(arr: Column, fn, zero: Column) -> Column:
        both = F.zip_with(F.slice(arr, F.lit(1), F.size(arr) - 1), F.slice(arr, F.lit(2), F.size(arr) - 1), fn)
        return F.aggregate(both, zero, lambda s, v: s + v)

    base = F.struct(
        a.alias("a"), n.alias("n"), squares.alias("sq"), values.alias("v"),
        neighbours(kinds, lambda x, y: F.when(x != y, 1.0).otherwise(0.0), F.lit(0.0)).alias("changes"),
    )

    def judged(t: Column) -> Column:
        n, a, sq, v = t["n"], t["a"], t["sq"], t["v"]
        pairs = n * (n - 1) / 2
        equal = (sq - n) / 2
        spread = F.sqrt(pairs * PROSE_PAIR * (1 - PROSE_PAIR) + n * (n - 1) * (n - 2) * (PROSE_TRIPLE - PROSE_PAIR**2))
        z_equal = (pairs * PROSE_PAIR - equal) / spread
        z_change = (t["changes"] - (n - 1) * PROSE_CHANGE) / F.sqrt((n - 1) * PROSE_CHANGE * (1 - PROSE_CHANGE))
        evidence = normal_tail((z_equal + z_change) / 2**0.5)
        k = a - 1
        z_chi = (F.pow(F.greatest(sq * a / n - n, F.lit(0.0)) / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
        high = F.size(F.filter(v, lambda x: x > 0)).cast("double")
        low = n - high
        runs = neighbours(v, lambda x, y: F.when((x > 0) != (y > 0), 1.0).otherwise(0.0), F.lit(1.0))
        mean_runs = 2 * high * low / n + 1
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        z_runs = F.when(var_runs > 0, F.abs(runs - mean_runs) / F.sqrt(var_runs)).otherwise(99.0)
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
        total = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
        lagged = neighbours(v, lambda x, y: (x - mean) * (y - mean), F.lit(0.0))
        z_serial = F.when(total > 0, F.abs(lagged / total) * F.sqrt(n)).otherwise(99.0)
        worst = F.greatest(normal_tail(z_chi), normal_tail(z_runs), normal_tail(z_serial))
        return F.struct(
            F.least(evidence, F.lit(300.0)).alias("evidence"),
            (worst < F.lit(-math.log10(REJECT))).alias("random"),
            F.length(F.bin(n.cast("bigint"))).alias("cls"),
        )

    return F.when(F.length(body) > 1, F.transform(F.array(base), judged)[0])


def candidates(text: Column) -> Column:
    """Candidate runs with their test results: array of struct(start, end, evidence, random, cls)."""
    spans = F.filter(_located(text, CANDIDATE), lambda r: F.length(F.regexp_replace(r["g"], "=+$", "")) >= 20)

    def tested(r: Column) -> Column:
        t = battery(r["g"])
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), t["evidence"].alias("evidence"), t["random"].alias("random"), t["cls"].alias("cls"))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,evidence:double,random:boolean,cls:int>>")
    return F.when(text.rlike(CANDIDATE), F.transform(spans, tested)).otherwise(empty)


def discovery_cuts(docs: DataFrame, text: str = "text", level: float = FDR) -> dict[int, float]:
    """Per length class (binary digits of the length) the least evidence that counts as a discovery.

    Benjamini-Hochberg over all candidates of all documents: the least x with
    10^-x * candidates <= level * (candidates of at least x). Evidence is counted in steps, so
    the result of the aggregation has at most 6,000 rows per class and 32 classes.
    """
    each = docs.select(F.explode(candidates(text_of(text))).alias("c")).select(
        F.col("c.cls").alias("cls"), F.floor(F.col("c.evidence") / STEP).cast("int").alias("step")
    )
    counts = each.groupBy("cls", "step").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("cls").orderBy(F.col("step").desc())
    ranked = counts.withColumns({"above": F.sum("n").over(down), "all": F.sum("n").over(Window.partitionBy("cls"))})
    good = ranked.where(F.pow(F.lit(10.0), -F.col("step") * STEP) * F.col("all") <= level * F.col("above"))
    return {r.cls: r.step * STEP for r in good.groupBy("cls").agg(F.min("step").alias("step")).collect()}


def scan_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", level: float = FDR) -> DataFrame:
    """All secret spans of every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Kind
    ``random`` holds what the battery adds where no fixed pattern has matched: tokens that are
    discoveries against prose and that no test finds unlike random characters. A null or empty
    text has no spans and the hash of the empty list. Repeated rows count each; a null id stays
    null; an empty table gives no rows.
    """
    cuts = discovery_cuts(docs, text, level)
    passes = F.lit(False)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text).alias("t"))
    spans = base_spans(F.col("t"))

    def named(kind: str, arr: Column) -> Column:
        return F.transform(arr, lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), r["end"].alias("end")))

    base = F.array_sort(F.concat(*[named(k, spans[k]) for k in ("assign", "access", "hex")]))
    rows = rows.select(
        "doc_id", base.alias("base"),
        *([candidates(F.col("t")).alias("more")] if cuts else []),
    )
    if cuts:
        def good(r: Column) -> Column:
            ok = passes
            for cls, cut in sorted(cuts.items()):
                ok = ok | ((r["cls"] == cls) & (F.floor(r["evidence"] / STEP) * STEP >= cut - STEP / 2))
            clear = ~F.exists(F.col("base"), lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
            return ok & r["random"] & clear

        more = named("random", F.filter("more", good))
    else:
        more = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    rows = rows.withColumn("more", more)

    def listed(arr: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(arr, lambda r: F.concat_ws(":", F.element_at(names, r["kind"] + 1), r["start"].cast("string"), r["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda r: r["kind"] == KINDS.index(kind))).cast("bigint")

    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("bigint").alias("n_random"),
    )

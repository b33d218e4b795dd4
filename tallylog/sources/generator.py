"""Sample logs, made by Spark from hashes of line numbers: the same lines for the same arguments, however they are partitioned."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of an access log: method, path, weight, and scale and shape of the response times, which follow Weibull laws.
ROUTES = (
    ("GET", "/catalog/{n}", 30, 0.018, 1.1),
    ("GET", "/catalog/{n}/reviews?page={k}", 14, 0.055, 0.9),
    ("PUT", "/basket/{n}/lines/{k}", 12, 0.031, 1.4),
    ("GET", "/media/thumb-{k}.webp", 25, 0.003, 2.0),
    ("POST", "/session", 6, 0.120, 1.2),
    ("GET", "/find?words=tea+{k}", 8, 0.240, 0.7),
    ("DELETE", "/basket/{n}", 3, 0.025, 1.4),
    ("POST", "/payments/{u}", 2, 0.610, 0.8),
)
#: Thousandths of the lines with each status; the others have 200.
STATUSES = ((204, 41), (301, 17), (403, 6), (410, 9), (429, 4), (502, 3), (503, 2))
#: The clock goes through cycles of so many lines: TICK ms a line, RUSH_TICK ms in the rush, and a pause at the end.
CYCLE, RUSH, TICK, RUSH_TICK, PAUSE = 300_000, (120_000, 150_000), 9, 1, 420_000
#: One line in so many is stamped LATE ms early, or is no log line.
EARLY, LATE, BROKEN = 25_013, 15_000, 9_973


def drawn(seed: int, salt: int, below: int) -> Column:
    """A number from 0 to ``below`` - 1 for each ``id``."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(below))


def clock(line: Column) -> Column:
    """Milliseconds since the first line."""
    first, last = RUSH
    at = line % CYCLE
    rush = F.greatest(F.lit(0), F.least(at, F.lit(last)) - first)
    whole = (CYCLE - last + first) * TICK + (last - first) * RUSH_TICK + PAUSE
    return F.floor(line / CYCLE) * whole + (at - rush) * TICK + rush * RUSH_TICK - F.when(line % EARLY == EARLY - 1, LATE).otherwise(0)


def one_of(weighted: list[tuple[Column, int]], draw: Column) -> Column:
    """The value into whose share of the weights ``draw`` falls; the last one beyond."""
    upto = sum(w for _, w in weighted)
    found = weighted[-1][0]
    for value, weight in reversed(weighted):
        upto -= weight
        found = F.when(draw < upto + weight, value).otherwise(found)
    return found


def access_lines(spark: SparkSession, n: int, seed: int = 5, start: int = 1_751_500_000, partitions: int | None = None) -> DataFrame:
    """``n`` lines (id, value) of an access log with rushes, pauses, lines out of order and broken ones."""
    return access_lines_of(spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism), seed, start)


def filled(template: str, values: dict[str, Column]) -> Column:
    """``template`` with values for the names in braces."""
    parts = re.split(r"\{(\w)\}", template)
    return F.concat(*[values[part] if k % 2 else F.lit(part) for k, part in enumerate(parts)])


def access_lines_of(rows: DataFrame, seed: int = 5, start: int = 1_751_500_000, others: Sequence[str] = ()) -> DataFrame:
    """A line (id, value) for each of ``rows``, by its whole number ``id``; ``others`` are columns that stay."""
    number, small = drawn(seed, 1, 900_000) + 1000, drawn(seed, 2, 40)
    text = lambda c: c.cast("string")
    values = {"n": text(F.col("n")), "k": text(F.col("k")), "u": F.format_string("%08x-%04x", F.col("n") * 4001, "k")}
    kinds = [(F.struct(F.lit(m).alias("m"), filled(p, values).alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b")), w) for m, p, w, a, b in ROUTES]
    status = one_of([*((F.lit(s), w) for s, w in STATUSES), (F.lit(200), 1000 - sum(w for _, w in STATUSES))], drawn(seed, 4, 1000))
    route = drawn(seed, 3, sum(w for *_, w, _, _ in ROUTES))
    rows = rows.select("id", *others, route.alias("route"), number.alias("n"), small.alias("k"), status.alias("status"), ((drawn(seed, 5, 1_000_000) + 1) / 1_000_001).alias("u"))
    rows = rows.withColumn("r", one_of(kinds, F.col("route")))
    took = (F.col("r.a") * F.pow(-F.log("u"), 1 / F.col("r.b"))).cast("decimal(20,4)")
    at = F.date_format(F.timestamp_millis(F.lit(start * 1000) + clock(F.col("id"))), "dd/MMM/yyyy:HH:mm:ss")
    line = F.concat(
        F.lit("203.0.113."), text(F.col("n") % 250 + 1), F.lit(" - - ["), at, F.lit(' +0000] "'), "r.m", F.lit(" "), "r.p", F.lit(' HTTP/2.0" '), text(F.col("status")), F.lit(" "), text(F.col("n") % 61_000 + 90),
        F.lit(' "-" "probe/'), text(F.col("k")), F.when(F.col("k") < 8, '" rt=').otherwise('" '), text(took),
    )
    return rows.select("id", *others, F.when(F.col("id") % BROKEN == BROKEN - 1, F.format_string("upstream closed after %d bytes", "n")).otherwise(line).alias("value"))


#: Of an application log: level word, weight, message.
MESSAGES = (
    ("INFO", 60, "order {n} stored in {k}ms"),
    ("DBG", 20, "cache {k} has {n} entries"),
    ("[warning]", 9, "queue depth {n} above mark {k}"),
    ("ERROR", 5, "could not reach broker-{k}: timeout after {k}s"),
    ("SEVERE:", 3, "lease {n} lost by worker {k}"),
    ("crit", 1, "disk {k} full, {n} blocks wanted"),
    ("trace", 2, "leaving step {k}"),
)


def app_lines(spark: SparkSession, n: int, seed: int = 6, start: int = 1_751_500_000, partitions: int | None = None) -> DataFrame:
    """``n`` lines (id, value) of an application log; a tenth of the lines continue the one before."""
    rows = spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism)
    number, small = drawn(seed, 1, 90_000) + 100, drawn(seed, 2, 30)
    kind = one_of([(F.struct(F.lit(a).alias("a"), F.lit(m).alias("m")), w) for a, w, m in MESSAGES], drawn(seed, 3, sum(w for _, w, _ in MESSAGES)))
    rows = rows.select("id", kind.alias("r"), number.alias("n"), small.alias("k"))
    said = F.replace(F.replace("r.m", F.lit("{n}"), F.col("n").cast("string")), F.lit("{k}"), F.col("k").cast("string"))
    stamp = F.date_format(F.timestamp_millis(F.lit(start * 1000) + clock(F.col("id"))), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    line = F.concat(stamp, F.lit("Z "), F.col("r.a"), F.lit(" "), said)
    return rows.select("id", F.when(F.col("id") % 10 == 9, F.format_string("    from frame %d", "k")).otherwise(line).alias("value"))


def write_log(lines: DataFrame, path: str) -> None:
    """Writes generated lines as text files below ``path``, in line order by file name."""
    lines.select("value").write.mode("overwrite").text(path)

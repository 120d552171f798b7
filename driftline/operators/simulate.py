"""Exit-rule simulation over forward paths.

Paths are rows (id, i, at, open, high, low, close) with the entry price; every rule is pessimistic
within a bar: a stop that a bar reaches is taken before its target. What ends a trade is found by
comparing first bars. Costs are additive, so a grid simulates each cell once without costs and adds them afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_where(condition: Column, value: Column | str) -> Column:
    return F.min(F.when(condition, F.col(value) if isinstance(value, str) else value))


def single_target(paths: DataFrame, stop_pct: float, target_pct: float) -> DataFrame:
    """Closed form: the first bar at the stop against the first at the target; of one bar the stop counts. Fills at the worse of stop and open."""
    stop, target = F.col("entry") * (1 - stop_pct / 100), F.col("entry") * (1 + target_pct / 100)
    hit = F.col("low") <= stop
    ends = paths.groupBy("id").agg(
        first_where(hit, "i").alias("stop_i"),
        F.min_by(F.when(hit, F.least(stop, F.col("open"))), F.when(hit, F.col("i"))).alias("fill"),
        first_where(F.col("high") >= target, "i").alias("target_i"),
        F.max_by("close", "i").alias("last"),
        F.max("i").alias("last_i"),
        F.first("entry").alias("entry"),
    )
    stopped = F.col("stop_i").isNotNull() & (F.col("target_i").isNull() | (F.col("stop_i") <= F.col("target_i")))
    gross = F.when(stopped, (F.col("fill") / F.col("entry") - 1) * 100).when(F.col("target_i").isNotNull(), F.lit(float(target_pct))).otherwise((F.col("last") / F.col("entry") - 1) * 100)
    reason = F.when(stopped, "stop").when(F.col("target_i").isNotNull(), "target").otherwise("time")
    bars = F.when(stopped, F.col("stop_i")).when(F.col("target_i").isNotNull(), F.col("target_i")).otherwise(F.col("last_i"))
    return ends.select("id", gross.alias("gross"), reason.alias("reason"), (bars + 1).cast("long").alias("bars"))


@dataclass(frozen=True)
class Grid:
    """Cells to simulate: every structure with every stop, horizon, and target or trail.

    single: all at the target. half: half at the target, the rest at twice it or back at the entry.
    trailing: half at the target, the rest `atr` below the highest high since. fat: all, a share below the highest
    high. ladder: a quarter each at 2 and 5 times the entry, the rest 40 % below the highest
    high from 2 times on. Stops are a percentage, a multiple of the atr, or the path's support.
    """

    structures: tuple[str, ...]
    stops: tuple[str, ...]
    hours: tuple[int, ...]
    targets: tuple[float, ...] = (0.0,)
    trails: tuple[float, ...] = (0.0,)


#: The exit and edge grids (fixed values): 144 and 48 cells, each at three costs.
EXITS = Grid(("half", "single", "trailing"), ("support", "fixed3", "fixed5", "atr1.5"), (2, 6, 24), targets=(5.0, 8.0, 10.0, 15.0))
EDGES = (Grid(("fat",), ("support", "fixed10", "fixed20", "atr2"), (24, 72, 168), trails=(20.0, 30.0, 40.0)), Grid(("ladder",), ("support", "fixed10", "fixed20", "atr2"), (24, 72, 168), trails=(40.0,)))
COSTS = (100, 200, 300)
HOUR = 3_600_000


def stop_price(kind: str) -> Column:
    """Null where the path has no such stop above 0 and below its entry."""
    entry = F.col("entry")
    if kind == "support":
        price = F.col("support")
    elif kind.startswith("fixed"):
        price = entry * (1 - float(kind[5:]) / 100)
    else:
        price = F.when(F.col("atr") > 0, entry - float(kind[3:]) * F.col("atr"))
    return F.when((price > 0) & (price < entry), price)


def first_bar(condition: Column, **values: Column) -> Column:
    """The first bar where a condition holds: its number and values there; null if there is none."""
    return F.min(F.when(condition, F.struct(F.col("i"), *[v.alias(k) for k, v in values.items()])))


def marked(paths: DataFrame, grid: Grid) -> DataFrame:
    """One row a path with the first bar of everything that can end a trade: arrays by stop, target, trail and horizon."""
    path = Window.partitionBy("id")
    before = path.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    entry, low, high, open_ = map(F.col, ("entry", "low", "high", "open"))
    reached = lambda multiple: F.min(F.when(high >= entry * multiple, F.col("i"))).over(path)
    goals = [F.lit(1 + t / 100) for t in grid.targets] if any(grid.targets) else []
    rows = paths.select("*", F.greatest("entry", F.max("high").over(before)).alias("top"), reached(2.0).alias("two"), *[reached(g).alias(f"a{k}") for k, g in enumerate(goals)], *[stop_price(s).alias(f"s{k}") for k, s in enumerate(grid.stops)])
    rows = rows.select("*", *[F.max(F.when(F.col("i") >= F.col(f"a{k}"), high)).over(before).alias(f"t{k}") for k in range(len(goals))])
    stops = range(len(grid.stops))
    struct = "struct<i:bigint,open:double,level:double>"
    level = lambda condition, price: first_bar(condition, open=open_, level=price).cast(struct)
    some = lambda columns, kind: F.array(*columns) if columns else F.array().cast(f"array<{kind}>")
    i = F.col("i")
    each = range(len(goals))
    return rows.groupBy("id").agg(
        F.first("entry").alias("entry"),
        F.first("atr").alias("atr"),
        F.min("at").alias("since"),
        F.max("two").alias("two"),
        F.min(F.when(high >= entry * 5, i)).alias("five"),
        F.array_sort(F.collect_list(F.struct(i, F.col("at"), F.col("close"), F.greatest("top", "high").alias("top")))).alias("bars"),  # a path is no longer than its longest horizon
        some([F.first(f"s{k}") for k in stops], "double").alias("stop"),
        some([level(low <= F.col(f"s{k}"), F.col(f"s{k}")) for k in stops], struct).alias("stopped"),
        some([level((i > F.col("two")) & (low <= F.col(f"s{k}")), F.col(f"s{k}")) for k in stops], struct).alias("stopped_late"),
        some([F.max(f"a{k}") for k in each], "bigint").alias("hit"),
        some([F.max(F.when(i == F.col(f"a{k}"), F.struct("low", "high"))) for k in each], "struct<low:double,high:double>").alias("at_hit"),
        some([F.min(F.when((i >= F.col(f"a{k}")) & (low <= entry), i)) for k in each], "bigint").alias("back"),
        some([F.min(F.when((i >= F.col(f"a{k}")) & (high >= entry * (1 + t / 50)), i)) for k, t in zip(each, grid.targets, strict=False)], "bigint").alias("double"),
        some([level((i > F.col(f"a{k}")) & (low <= F.col(f"t{k}") - F.col("atr")), F.col(f"t{k}") - F.col("atr")) for k in each], struct).alias("trailed"),
        some([some([level((i > F.col(f"a{k}")) & (low <= F.col(f"s{j}")), F.col(f"s{j}")) for j in stops], struct) for k in each], f"array<{struct}>").alias("stopped_after"),
        some([level((i > 0) & (low <= F.col("top") * (1 - t / 100)), F.col("top") * (1 - t / 100)) for t in grid.trails], struct).alias("fell"),
        some([level((i > F.col("two")) & (low <= F.col("top") * (1 - t / 100)), F.col("top") * (1 - t / 100)) for t in grid.trails], struct).alias("fell_late"),
    )


def simulate(paths: DataFrame, grid: Grid, bar: int) -> DataFrame:
    """id, structure, stop, hours, target, trail, gross (percent), reason, bars, best (highest multiple), resolved, exit_at of each path and cell.

    paths: id, i (0 first), at, open, high, low, close, entry, atr, support. Within a bar a stop
    comes before a target, and fills at the worse of stop and open. What ends a trade is a
    comparison of first bars, so a path is aggregated once, whatever the number of cells; no bar is
    repeated a cell. Cells without a valid stop, and trailing ones without an atr, have no row.
    """
    lit = lambda values: F.array(*map(F.lit, values))
    n_s, n_h, n_t, n_p = map(len, (grid.stops, grid.hours, grid.targets, grid.trails))
    cell = F.col("cell")
    index = {"h": cell % n_h, "s": F.floor(cell / n_h) % n_s, "p": F.floor(cell / (n_h * n_s)) % n_p, "t": F.floor(cell / (n_h * n_s * n_p)) % n_t, "u": F.floor(cell / (n_h * n_s * n_p * n_t))}
    rows = marked(paths, grid).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(grid.structures) * n_s * n_h * n_t * n_p - 1))).alias("cell"))
    rows = rows.select("*", *[v.cast("int").alias(k) for k, v in index.items()])
    rows = rows.select("*", F.get(lit(grid.structures), F.col("u")).alias("structure"), F.get(lit(grid.hours), F.col("h")).alias("hours"), F.get(lit(grid.targets), F.col("t")).alias("target"), F.get(lit(grid.trails), F.col("p")).alias("trail"), F.get("stop", F.col("s")).alias("level"))
    end = F.col("since") + F.col("hours") * HOUR
    rows = rows.select("*", F.size(F.filter("bars", lambda b: b["at"] < end)).alias("n")).where((F.col("n") > 0) & F.col("level").isNotNull() & ((F.col("structure") != "trailing") | (F.col("atr") > 0)))
    n, level, entry, target, structure = map(F.col, ("n", "level", "entry", "target", "structure"))
    inside = lambda x: F.when(x < n, x)
    event = lambda c: F.when(c["i"] < n, c)
    rows = rows.select(
        "*",
        event(F.get("stopped", F.col("s"))).alias("x_stop"),
        inside(F.get("hit", F.col("t"))).alias("x_hit"),
        inside(F.get("back", F.col("t"))).alias("x_back"),
        inside(F.get("double", F.col("t"))).alias("x_double"),
        inside(F.col("two")).alias("x_two"),
        F.get("at_hit", F.col("t")).alias("act"),
        event(F.when(structure == "trailing", F.get("trailed", F.col("t"))).when(structure == "fat", F.get("fell", F.col("p"))).otherwise(F.get("fell_late", F.col("p")))).alias("x_trail"),
        event(F.when(structure == "trailing", F.get(F.get("stopped_after", F.col("t")), F.col("s"))).when(structure == "fat", F.get("stopped", F.col("s"))).otherwise(F.get("stopped_late", F.col("s")))).alias("x_late"),
    )
    # a stop before (or in the bar of) what turns it into something else
    turn = F.when(structure == "ladder", F.col("x_two")).otherwise(F.col("x_hit"))
    early = (structure != "fat") & F.col("x_stop").isNotNull() & (turn.isNull() | (F.col("x_stop.i") <= turn))
    # of the falling level and the plain stop the one that is met first; in one bar the higher one counts
    falls_first = F.col("x_trail").isNotNull() & (F.col("x_late").isNull() | (F.col("x_trail.i") <= F.col("x_late.i")))
    late = F.when(falls_first, F.struct(F.col("x_trail.i"), F.least(F.greatest(level, F.col("x_trail.level")), F.col("x_trail.open")).alias("price"))).when(F.col("x_late").isNotNull(), F.struct(F.col("x_late.i"), F.least(level, F.col("x_late.open")).alias("price")))
    at_once = F.greatest(level, F.col("act.high") - F.col("atr"))
    ends = lambda i, price, reason: F.struct(i.cast("bigint").alias("i"), price.alias("price"), F.lit(reason).alias("reason"))
    whole = F.when(early, ends(F.col("x_stop.i"), F.least(level, F.col("x_stop.open")), "stop"))
    goal = entry * (1 + target / 100)
    backs = F.col("x_back").isNotNull() & (F.col("x_double").isNull() | (F.col("x_back") <= F.col("x_double")))
    over = (
        whole.when((structure == "single") & F.col("x_hit").isNotNull(), ends(F.col("x_hit"), goal, "tp"))
        .when((structure == "half") & backs, ends(F.col("x_back"), entry, "breakeven"))
        .when((structure == "half") & F.col("x_double").isNotNull(), ends(F.col("x_double"), entry * (1 + target / 50), "tp2"))
        .when((structure == "trailing") & F.col("x_hit").isNotNull() & (F.col("act.low") <= at_once), ends(F.col("x_hit"), at_once, "trail"))
        .when(((structure == "fat") | turn.isNotNull()) & structure.isin("fat", "trailing", "ladder") & late.isNotNull(), ends(late["i"], late["price"], "trail"))
    )
    rows = rows.select("*", over.alias("over"), turn.alias("turn"), early.alias("early"))
    last = F.get("bars", n - 1)
    done = F.col("over").isNotNull()
    at = F.coalesce(F.col("over.i"), (n - 1).cast("bigint")).cast("int")
    price = F.coalesce(F.col("over.price"), last["close"])
    complete = last["at"] + bar >= end
    pct = (price / entry - 1) * 100
    turned = F.col("turn").isNotNull() & ~F.col("early")
    five = (F.col("five") < F.when(done, at).otherwise(n)) & turned
    gross = (
        F.when(structure.isin("half", "trailing") & turned, (target + pct) / 2)
        .when((structure == "ladder") & F.coalesce(five, F.lit(False)), 125 + 0.5 * pct)
        .when((structure == "ladder") & turned, 25 + 0.75 * pct)
        .otherwise(pct)
    )
    seen = F.when(done & structure.isin("fat", "ladder"), at - 1).otherwise(at)  # there a bar that ends the trade shows no high
    best = F.when(seen < 0, F.lit(1.0)).otherwise(F.get("bars", F.greatest(seen, F.lit(0)))["top"] / entry)
    return rows.select(
        "id", "structure", F.get(lit(grid.stops), F.col("s")).alias("stop"), "hours", "target", "trail",
        gross.alias("gross"),
        F.when(done, F.col("over.reason")).when(complete, "time").otherwise("open").alias("reason"),
        (at + 1).cast("bigint").alias("bars"),
        best.alias("best"),
        (done | complete).alias("resolved"),
        (F.get("bars", at)["at"] + bar).alias("exit_at"),
    )


def with_costs(results: DataFrame, bps: list[int]) -> DataFrame:
    """Each result at each cost; net = gross - bps / 100."""
    return results.select("*", F.explode(F.array(*map(F.lit, bps))).alias("cost_bps")).select("*", (F.col("gross") - F.col("cost_bps") / 100).alias("net"))

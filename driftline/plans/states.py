"""Queries over folds: recurrences in which a row's outcome hangs on those before, over the table of events and over its stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import folds, paper
from driftline.plans.registry import Registry
from driftline.plans.views import HOUR, millis, table
from driftline.streaming import sinks, stateful, streams

reg = Registry()
K = ["user_id"]
#: The clock at the end of a batch: 1 February 2024, after all events.
END = 1_706_745_600_000
MINUTES = 60_000

ADMISSION = folds.Admission(2)
OUTCOME = folds.Outcome(0.5, 1.5, 3.0)
POSITION = folds.Position(0.5, 1.5, 4.0, 30.0)
FIXED = folds.Position(0.5, 1.5, 4.0, None)
COVERAGE = folds.Coverage(60 * MINUTES, 30 * MINUTES)
DELIVERY = folds.Delivery(6 * HOUR, 12 * HOUR, 24 * HOUR)

EVENTS = "ev AS (SELECT user_id, epoch_us(ts) // 1000 AS at, event_id AS id, event_type, value FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at, id) AS rn FROM ev), newest AS (SELECT max(at) AS newest FROM ev)"


def events(spark, d):
    return table(spark, d, "events").select("user_id", millis("ts").alias("at"), F.col("event_id").alias("id"), "event_type", "value")


def stream(spark, d):
    return streams.events(spark, d).withColumnRenamed("event_id", "id")


# ---- admissions

def requests(e):
    """Every event asks for one of its type; every eleventh is stale; an admission counts a day from when it was sent, up to 20 minutes later."""
    at = F.col("at") if "at" in e.columns else F.unix_millis("ts")
    return e.withColumns({"token": F.col("event_type"), "fresh": F.col("id") % 11 != 0, "until": at + 24 * HOUR + F.col("id") % 3 * (10 * MINUTES)})


ADMITTED = f"""WITH RECURSIVE {EVENTS}, q AS (SELECT user_id, at, id, rn, event_type AS token, id % 11 <> 0 AS fresh, at + {24 * HOUR} + id % 3 * {10 * MINUTES} AS until FROM o),
r AS (SELECT user_id, at, id, rn, CASE WHEN NOT fresh THEN 'stale' END AS reason, CASE WHEN fresh THEN [{{'token': token, 'until': until}}] ELSE [] END AS held FROM q WHERE rn = 1
UNION ALL SELECT user_id, at, id, rn, reason, CASE WHEN reason IS NULL THEN list_append(live, {{'token': token, 'until': until}}) ELSE live END FROM (
  SELECT *, CASE WHEN NOT fresh THEN 'stale' WHEN len(live) >= 2 THEN 'limit' WHEN list_contains(list_transform(live, lambda x: x.token), token) THEN 'token' END AS reason FROM (
    SELECT q.*, list_filter(r.held, lambda x: x.until > q.at) AS live FROM r JOIN q ON q.user_id = r.user_id AND q.rn = r.rn + 1)))
SELECT user_id, id, at, reason IS NULL AS admitted, reason FROM r"""


@reg.query(ADMITTED)
def admission(spark, d):
    """Requests of each account that a limit of two a day and a cooldown a token let in; refused ones use nothing up."""
    return folds.folded(requests(events(spark, d)), K, ADMISSION)


@reg.query(f"{ADMITTED}, newest WHERE at < newest")
def stream_admission(spark, d):
    return streams.replay(stateful.folded(requests(stream(spark, d)), K, ADMISSION)).join(newest(spark, d), F.col("at") < F.col("newest")).drop("newest")


def newest(spark, d):
    """The newest time, which a stream's watermark reaches but does not pass."""
    return F.broadcast(events(spark, d).agg(F.max("at").alias("newest")))


# ---- paper accounts

POLICY = paper.Policy(paper.D(1000), paper.D(40), 3, 2, paper.D(60), fee=paper.D("0.01"), slip=paper.D("0.005"), network=paper.D("0.2"), fresh=12 * HOUR, signal_age=HOUR)


def account_rows(e):
    """Every event quotes its type in one of two pools; every third sends a signal right after, of up to 70 minutes before; every 97th pauses the account and every 89th resumes it."""
    at = F.col("at") if "at" in e.columns else F.unix_millis("ts")
    rows = F.array(
        F.struct(F.col("id") * 3, F.lit("quote")), F.when(F.col("id") % 3 == 0, F.struct(F.col("id") * 3 + 1, F.lit("signal"))),
        F.when(F.col("id") % 97 == 0, F.struct(F.col("id") * 3 + 2, F.lit("pause"))), F.when(F.col("id") % 89 == 0, F.struct(F.col("id") * 3 + 2, F.lit("resume"))),
    )
    each = e.withColumns({"quote_at": at, "signal_at": at - F.col("id") % 71 * MINUTES, "token": F.col("event_type"), "pool": (F.col("id") % 11 == 0).cast("string"), "price": F.col("value") + 20, "__r": F.explode(F.array_compact(rows))})
    return each.withColumns({"id": F.col("__r.col1"), "kind": F.col("__r.col2")}).drop("__r")


@reg.query()
def paper_account(spark, d):
    """Every entry, refusal and sale of each account's shared cash, with its limits by day and cooldowns by token."""
    return paper.replay(account_rows(events(spark, d)), K, POLICY)


@reg.query()
def stream_paper_account(spark, d):
    return streams.replay(stateful.folded(account_rows(stream(spark, d)), K, paper.Account(POLICY))).join(newest(spark, d), F.col("at") < F.col("newest")).drop("newest")


@reg.query()
def paper_refusals(spark, d):
    """How often each reason was the first to refuse an entry."""
    return paper_account(spark, d).where("event = 'refuse'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- outcomes

def prices(e):
    return e.withColumns({"price": F.col("value") + 1, "liquidity": F.col("value") * 200})


OUTCOMES = f"""WITH RECURSIVE {EVENTS}, s AS (SELECT user_id, min(at) AS since FROM o GROUP BY 1 UNION ALL SELECT s.user_id, (SELECT min(o.at) FROM o WHERE o.user_id = s.user_id AND o.at > s.since + {24 * HOUR}) FROM s WHERE s.since IS NOT NULL),
w AS (SELECT s.user_id, s.since, o.at, o.id, o.value + 1 AS price, first_value(o.value + 1) OVER (PARTITION BY s.user_id, s.since ORDER BY o.at, o.id) AS entry FROM s JOIN o ON o.user_id = s.user_id AND o.at BETWEEN s.since AND s.since + {24 * HOUR}),
g AS (SELECT user_id, since, any_value(entry) AS entry, min(price) AS low, max(price) AS high, min(at) FILTER (price <= entry * 0.5::DOUBLE) AS st, min(at) FILTER (price >= entry * 1.5::DOUBLE) AS tp1_at, min(at) FILTER (price >= entry * 3.0::DOUBLE) AS tp2_at, count(*) AS n FROM w GROUP BY ALL),
out AS (SELECT user_id, since, entry, low, high, CASE WHEN st < tp1_at OR (st IS NOT NULL AND tp1_at IS NULL) THEN 'stop' WHEN tp1_at IS NOT NULL THEN 'tp1' END AS first_hit, CASE WHEN st < tp1_at OR tp1_at IS NULL THEN st END AS stop_at, tp1_at, tp2_at, n FROM g)
SELECT * FROM out"""


@reg.query(OUTCOMES)
def outcome_day(spark, d):
    """What follows a first price within a day: one row a window, complete by the clock."""
    return folds.folded(prices(events(spark, d)), K, OUTCOME, END)


@reg.query(f"SELECT user_id, since, entry, low, high, first_hit, stop_at, tp1_at, tp2_at, n FROM ({OUTCOMES}), (SELECT max(epoch_us(ts) // 1000) AS newest FROM events) WHERE since + {24 * HOUR} < newest")
def stream_outcome_day(spark, d):
    found = streams.replay(stateful.folded(prices(stream(spark, d)), K, OUTCOME))
    return found.join(newest(spark, d), F.col("since") + 24 * HOUR < F.col("newest")).drop("newest")


# ---- positions

def positions_sql(trail: bool) -> str:
    """Row by row: the state before (none: a new position), the first event that holds, the state after."""
    mark = "greatest(entry, top * (1 - 30.0::DOUBLE / 100))" if trail else "entry"
    high = "CASE WHEN half THEN greatest(high, price) END" if trail else "NULL::DOUBLE"
    level = "greatest(10000.0::DOUBLE, depth * 0.5::DOUBLE)"
    state = "coalesce(r.since, p.at) AS since, coalesce(r.entry, p.price) AS entry, coalesce(r.depth, p.liquidity) AS depth, coalesce(r.half, false) AS half, r.high, coalesce(r.warned, false) AS warned"
    event = f"CASE WHEN NOT half AND price <= entry * 0.5::DOUBLE THEN 'stop' WHEN price >= entry * 4.0::DOUBLE THEN 'tp2' WHEN NOT half AND price >= entry * 1.5::DOUBLE THEN 'tp1' WHEN half AND price <= {mark} THEN '{'trail' if trail else 'breakeven'}' WHEN liquidity < {level} THEN 'liquidity' END"
    after = f"""SELECT user_id, at, id, rn, price, since, kind, level, told, CASE WHEN NOT over THEN since END AS since2, CASE WHEN NOT over THEN entry END AS entry2, CASE WHEN NOT over THEN depth END AS depth2, CASE WHEN NOT over THEN half OR coalesce(kind = 'tp1', false) END AS half2,
      CASE WHEN NOT over THEN CASE WHEN kind = 'tp1' THEN greatest(entry * 1.5::DOUBLE, price) ELSE top END END AS high2, CASE WHEN NOT over THEN warned OR coalesce(kind = 'liquidity', false) END AS warned2 FROM (
      SELECT *, coalesce(kind IN ('stop', 'tp2', 'trail', 'breakeven'), false) AS over, kind IS NOT NULL AND NOT (kind = 'liquidity' AND warned) AS told,
        CASE kind WHEN 'stop' THEN entry * 0.5::DOUBLE WHEN 'tp2' THEN entry * 4.0::DOUBLE WHEN 'tp1' THEN entry * 1.5::DOUBLE WHEN 'trail' THEN {mark} WHEN 'breakeven' THEN entry WHEN 'liquidity' THEN {level} END AS level FROM (
        SELECT *, {event} AS kind FROM (SELECT *, {high} AS top FROM (SELECT p.user_id, p.at, p.id, p.rn, p.price, p.liquidity, {state} FROM %s))))"""
    start = "(SELECT NULL::BIGINT AS since, NULL::DOUBLE AS entry, NULL::DOUBLE AS depth, NULL::BOOLEAN AS half, NULL::DOUBLE AS high, NULL::BOOLEAN AS warned) r, p WHERE p.rn = 1"
    step = "(SELECT user_id, rn, since2 AS since, entry2 AS entry, depth2 AS depth, half2 AS half, high2 AS high, warned2 AS warned FROM r) r JOIN p ON p.user_id = r.user_id AND p.rn = r.rn + 1"
    return f"WITH RECURSIVE {EVENTS}, p AS (SELECT user_id, at, id, rn, value + 1 AS price, value * 200 AS liquidity FROM o), r AS ({after % start} UNION ALL {after % step}) SELECT user_id, since, at, kind, price, level FROM r"


@reg.query(f"{positions_sql(True)} WHERE told")
def position_trailed(spark, d):
    """Events of each account's positions one after another, the rest of each trailed after its first profit."""
    return folds.folded(prices(events(spark, d)), K, POSITION)


@reg.query(f"{positions_sql(False)} WHERE told")
def position_breakeven(spark, d):
    """As position_trailed, the rest closed at the entry."""
    return folds.folded(prices(events(spark, d)), K, FIXED)


@reg.query(f"{positions_sql(True)}, newest WHERE told AND at < newest")
def stream_position_events(spark, d):
    return streams.replay(stateful.folded(prices(stream(spark, d)), K, POSITION)).join(newest(spark, d), F.col("at") < F.col("newest")).drop("newest")


# ---- coverage of sources

COVERED = f"""WITH {EVENTS}, s AS (SELECT user_id % 5 AS source, at, event_type = 'error' AS gap FROM o),
t AS (SELECT source, at FROM s UNION SELECT source, at + {60 * MINUTES} FROM s WHERE gap UNION SELECT source, at + {30 * MINUTES} FROM s WHERE NOT gap),
m AS (SELECT source, at, max(g) OVER w AS g, max(f) OVER w AS f FROM (SELECT t.source, t.at, max(s.at) FILTER (s.gap) AS g, max(s.at) FILTER (NOT s.gap) AS f FROM t LEFT JOIN s ON s.source = t.source AND s.at = t.at GROUP BY ALL) WINDOW w AS (PARTITION BY source ORDER BY at)),
c AS (SELECT source, at, CASE WHEN g + {60 * MINUTES} > at THEN 'warming' WHEN f + {30 * MINUTES} > at THEN 'healthy' ELSE 'stale' END AS status FROM m),
x AS (SELECT *, lag(status) OVER (PARTITION BY source ORDER BY at) AS before FROM c) SELECT source, at, status FROM x{{}} WHERE status IS DISTINCT FROM before AND at {{}}"""


def sources(e):
    return e.withColumns({"source": F.col("user_id") % 5, "gap": F.col("event_type") == "error"})


@reg.query(COVERED.format("", f"<= {END}"))
def coverage_status(spark, d):
    """Each source's changes between warming up after a gap, healthy and stale, by rows and by the clock."""
    return folds.folded(sources(events(spark, d)), ["source"], COVERAGE, END)


@reg.query(COVERED.format(", newest", "< newest"))
def stream_coverage(spark, d):
    return streams.replay(stateful.folded(sources(stream(spark, d)), ["source"], COVERAGE)).join(newest(spark, d), F.col("at") < F.col("newest")).drop("newest")


# ---- deliveries

TO = {"signup": "reserved", "view": "reserved", "click": "sending", "purchase": "sent", "error": "failed"}


def wishes(e):
    to = F.coalesce(F.create_map(*[F.lit(x) for kv in TO.items() for x in kv])[F.col("event_type")], F.lit("reserved"))
    return e.withColumn("to", to)


DELIVERED = f"""WITH RECURSIVE {EVENTS}, q AS (SELECT user_id, at, id, rn, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TO.items())} ELSE 'reserved' END AS want FROM o),
r AS (SELECT user_id, at, id, rn, CASE WHEN want = 'reserved' THEN want END AS status, CASE WHEN want = 'reserved' THEN at END AS since, NULL::BIGINT AS ended, want = 'reserved' AS told, NULL::BIGINT AS lapsed FROM q WHERE rn = 1
UNION ALL SELECT user_id, at, id, rn, CASE WHEN go THEN want ELSE status END, CASE WHEN go AND want = 'reserved' THEN at ELSE since END, CASE WHEN go AND want IN ('sent', 'failed') THEN at WHEN go THEN NULL ELSE ended END, go, lapsed FROM (
  SELECT *, coalesce((status IS NULL AND want = 'reserved') OR (status = 'reserved' AND want = 'sending' AND at - since < {6 * HOUR}) OR (status = 'sending' AND want IN ('sent', 'failed')), false) AS go FROM (
    SELECT user_id, at, id, rn, want, lapsed, CASE WHEN over THEN NULL ELSE status END AS status, CASE WHEN over THEN NULL ELSE since END AS since, CASE WHEN over THEN NULL ELSE ended END AS ended FROM (
      SELECT *, coalesce(ended + {24 * HOUR} < at, false) AS over FROM (
        SELECT q.*, l.lapsed, CASE WHEN l.lapsed IS NOT NULL THEN 'unknown' ELSE r.status END AS status, r.since, coalesce(l.lapsed, r.ended) AS ended FROM r JOIN q ON q.user_id = r.user_id AND q.rn = r.rn + 1,
          LATERAL (SELECT CASE WHEN r.status IN ('reserved', 'sending') AND r.since + {12 * HOUR} < q.at THEN r.since + {12 * HOUR} END AS lapsed) l))))),
final AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1),
out AS (SELECT user_id, id, at, status FROM r WHERE told UNION ALL SELECT user_id, NULL, lapsed, 'unknown' FROM r WHERE lapsed IS NOT NULL UNION ALL SELECT user_id, NULL, since + {12 * HOUR}, 'unknown' FROM final WHERE status IN ('reserved', 'sending'))
SELECT user_id, id, at, status FROM out"""


@reg.query(f"{DELIVERED} WHERE at <= {END}")
def delivery_status(spark, d):
    """Messages reserved, started and ended at most once; what is left hanging becomes unknown by the clock."""
    return folds.folded(wishes(events(spark, d)), K, DELIVERY, END)


@reg.query(f"{DELIVERED}, newest WHERE at < newest")
def stream_delivery_status(spark, d):
    return streams.replay(stateful.folded(wishes(stream(spark, d)), K, DELIVERY)).join(newest(spark, d), F.col("at") < F.col("newest")).drop("newest")


# ---- sinks of streams

SEEN = "user_id long, first_seen long, last_seen long"


def landed(spark, d):
    """The stream of events, each third one twice and each seventh anew with another value later on."""
    e = stream(spark, d).withColumn("at", F.unix_millis("ts"))
    copies = F.when(F.col("id") % 7 == 0, F.array(F.lit(0), F.lit(1))).when(F.col("id") % 3 == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    return e.select("id", "user_id", F.explode(copies).alias("again"), "at", "value").select("id", "user_id", (F.col("at") + F.col("again") * 5_000).alias("at"), (F.col("value") + F.col("again")).alias("value"))


def sunk(spark, d, write):
    """The folder of a stream's sink after all of it."""
    path = streams.scratch(spark)
    sinks.run(landed(spark, d), write(path), f"{path}/state")
    return path


def first_rows(path):
    return sinks.Log(f"{path}/rows", "id long, user_id long, at long, value double")


@reg.query("SELECT event_id AS id, user_id, epoch_us(ts) // 1000 AS at, value FROM events")
def stream_insert_ignore(spark, d):
    """Rows that came first under their ids."""
    path = sunk(spark, d, lambda p: sinks.insert_ignore(first_rows(p), ["id"], ["at", "value"]))
    return streams.kept(first_rows(path).read(spark), path)


@reg.query("SELECT user_id, min(epoch_us(ts) // 1000) AS first_seen, max(epoch_us(ts) // 1000) AS last_seen FROM events GROUP BY user_id")
def stream_seen(spark, d):
    """First and last times of accounts, from newly inserted rows only."""
    seen = lambda p: sinks.Table(f"{p}/seen", SEEN)
    path = sunk(spark, d, lambda p: sinks.insert_with_seen(first_rows(p), seen(p), ["id"], ["at", "value"], ["user_id"]))
    return streams.kept(seen(path).read(spark), path)


@reg.query("SELECT event_id AS id, user_id, epoch_us(ts) // 1000 + CASE WHEN event_id % 7 = 0 THEN 5000 ELSE 0 END AS at, value + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS value FROM events")
def stream_upsert(spark, d):
    """Rows that came last under their ids."""
    table_at = lambda p: sinks.Table(f"{p}/rows", "id long, user_id long, at long, value double")
    path = sunk(spark, d, lambda p: sinks.upsert(table_at(p), ["id"], "at"))
    return streams.kept(table_at(path).read(spark), path)

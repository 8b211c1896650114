"""Registered checks, ledgers, lookups and digests, each with its SQL. Faults are planted from columns of the tables, so both outcomes occur."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import checks as ck
from ..operators import features as ft
from ..operators import inference as inf
from ..operators import quality as ql
from ..sources import bars as src
from ..sources import files as fl
from ..sources import resume as rs
from ..sources import store
from . import oracles as O  # noqa: N812
from .registry import _OBS, _QUALITY, SQL, TAPE, _bars, _feats, _observations, boot_sql, query

# -- sources and sinks -------------------------------------------------------------------------------------


@query("src_parse_ts", "SELECT event_id, epoch_us(ts) AS at_us FROM events")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return e.select("event_id", src.parse_micros(text).alias("at_us"))


_NAMES = "m AS (SELECT s_suppkey, DATE '1900-01-01' AS lo, DATE '1996-01-01' AS hi, s_name || '.a' AS code FROM supplier UNION ALL SELECT s_suppkey, DATE '1996-01-01', DATE '2200-01-01', s_name || '.b' FROM supplier)"


@query("src_dbn", f"WITH {_NAMES} SELECT code, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, count(*) AS n, CAST(min(round(l_extendedprice * 100)) AS BIGINT) AS low, CAST(max(round(l_extendedprice * 100)) AS BIGINT) AS high, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem JOIN m ON l_suppkey = s_suppkey AND CAST(l_shipdate AS DATE) >= lo AND CAST(l_shipdate AS DATE) < hi GROUP BY 1, 2")
def _(spark, sf):
    """Interleaved records of many instruments, written as record files in time order, read in splits, named by date and brought together by name and day."""
    r = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.unix_date(F.col("l_shipdate").cast("date")) * F.lit(86_400_000_000_000)).alias("ts"), F.col("l_suppkey").alias("instrument"), F.col("l_quantity").cast("long").alias("size"), (F.round(F.col("l_extendedprice") * 100).cast("long") * 10_000_000).alias("price"))
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    fl.write_records(r.repartitionByRange("ts").sortWithinPartitions("ts"), folder)
    x = fl.read_records(spark, folder, 10_000).select("instrument", F.date_from_unix_date(F.expr("int(ts div 86400000000000)")).alias("day"), F.expr("price div 10000000").alias("px"), F.col("size").alias("l_quantity"))
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    part = lambda lo, hi, end: s.select(F.col("s_suppkey").alias("m_instrument"), F.lit(lo).cast("date").alias("lo"), F.lit(hi).cast("date").alias("hi"), F.concat("s_name", F.lit(end)).alias("code"))
    named = ck.resolve(x, part("1900-01-01", "1996-01-01", ".a").unionByName(part("1996-01-01", "2200-01-01", ".b")), "instrument", "day")
    return named.groupBy("code", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.min("px").alias("low"), F.max("px").alias("high"), F.sum("l_quantity").cast("long").alias("volume"))


def _replay(spark, df, schema: str):
    """A table written as replay files in time order, and read back in splits with file and line."""
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    columns = [c.split()[0] for c in src.SCHEMAS[schema].split(", ")]
    instant = F.concat(F.date_format(F.timestamp_micros("at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("observed_at")
    ordered = df.repartitionByRange("at").sortWithinPartitions("at").select(instant, *columns[1:])
    ordered.write.option("header", True).option("emptyValue", "").option("nullValue", "").csv(folder)
    return fl.read_replay(spark, sorted(spark.read.text(folder).inputFiles()), schema, 1 << 16)


@query("src_csv_bars", f"WITH {O.BARS} SELECT os * 1000000 AS at, o / 100.0::DOUBLE AS open, h / 100.0::DOUBLE AS high, l / 100.0::DOUBLE AS low, c / 100.0::DOUBLE AS close, v AS volume, CASE WHEN v % 2 = 0 THEN v END AS trade_count FROM bars")
def _(spark, sf):
    price = lambda c: (F.col(c) / F.lit(100).cast("decimal(4,0)")).cast("decimal(18,2)")
    b = src.bars_from_events(spark, sf).select((F.col("os") * 1_000_000).alias("at"), *[price(c).alias(n) for c, n in zip("ohlc", ("open", "high", "low", "close"), strict=True)], F.col("v").alias("volume"), F.when(F.col("v") % 2 == 0, F.col("v")).alias("trade_count"))
    return _replay(spark, b, "bars").select("at", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], "volume", "trade_count")


@query("src_csv_trades", "SELECT epoch_us(ts) AS at, round(value, 2) AS price, user_id AS size, CASE WHEN user_id % 2 = 0 THEN event_type END AS aggressor, event_id AS sequence FROM events")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.round("value", 2).cast("decimal(18,2)").alias("price"), F.col("user_id").alias("size"), F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("aggressor"), F.col("event_id").alias("sequence"))
    return _replay(spark, e, "trades").select("at", F.col("price").cast("double").alias("price"), "size", F.when(F.col("aggressor") != "", F.col("aggressor")).alias("aggressor"), "sequence")


@query("src_csv_tob", "SELECT epoch_us(ts) AS at, CASE WHEN user_id % 3 > 0 THEN round(value, 2) END AS bid_price, CASE WHEN user_id % 3 > 0 THEN user_id END AS bid_size, CASE WHEN user_id % 3 < 2 THEN round(value, 2) + 1 END AS ask_price, CASE WHEN user_id % 3 < 2 THEN event_id END AS ask_size FROM events")
def _(spark, sf):
    """Quotes of one side or both."""
    px, side = F.round("value", 2).cast("decimal(18,2)"), F.col("user_id") % 3
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.when(side > 0, px).alias("bid_price"), F.when(side > 0, F.col("user_id")).alias("bid_size"), F.when(side < 2, px + 1).alias("ask_price"), F.when(side < 2, F.col("event_id")).alias("ask_size"))
    return _replay(spark, e, "top_of_book").select("at", F.col("bid_price").cast("double").alias("bid_price"), "bid_size", F.col("ask_price").cast("double").alias("ask_price"), "ask_size")


@query("snk_config", "SELECT digest, CASE min(r) WHEN 1 THEN 'F' ELSE 'rest' END AS writer FROM (SELECT sha256(o_custkey || '|' || o_orderpriority) AS digest, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS r FROM orders) GROUP BY digest")
def _(spark, sf):
    """Two writers upsert overlapping configurations by digest; what the first one stored stays, each digest has one row."""
    d = spark.read.parquet(f"{sf}/orders.parquet").select(F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"), 256).alias("digest"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("rest").alias("writer"))
    folder = f"{shared_folder(spark)}/configs-{uuid.uuid4().hex}"
    for writer in ("F", "rest"):
        store.upsert_configs(d.where(F.col("writer") == writer), folder)
    return store.stored_configs(spark, folder, "digest string, writer string")


@query("snk_ckpt", f"SELECT symbol, session_date, n, true AS resumed FROM ({SQL['records_long']})")
def _(spark, sf):
    """A study of two stages, stopped behind the first and run again: the first stage is read back, not built."""
    folder = f"{shared_folder(spark)}/study-{uuid.uuid4().hex}"
    identity = {"inputs": rs.input_digest(spark.read.parquet(f"{sf}/events.parquet")), "interval": src.INTERVAL}
    rs.Study(spark, folder, identity).stage("features", lambda: ft.records(_feats(spark, sf)))
    again = rs.Study(spark, folder, identity)
    r = again.stage("features", lambda: ft.records(_feats(spark, sf)))
    counts = again.stage("counts", lambda: r.groupBy("symbol", "session_date").agg(F.count("*").alias("n")))
    return counts.withColumn("resumed", F.lit(again.resumed == ["features"] and again.made == ["counts"]))


@query("j_ledger", "SELECT coalesce(a.k, b.k) AS key, a.k IS NULL AS only_right, b.k IS NULL AS only_left FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'N') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def _(spark, sf):
    """Keys that one of two ledgers lacks."""
    a = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("a")).distinct()
    b = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("b")).distinct()
    x = a.join(b, F.col("a") == F.col("b"), "full_outer").where("a is null or b is null")
    return x.select(F.coalesce("a", "b").alias("key"), F.col("a").isNull().alias("only_right"), F.col("b").isNull().alias("only_left"))


@query("snk_features", f"SELECT CASE WHEN day(CAST(session_date AS DATE)) % 2 = 0 THEN 'even' ELSE 'odd' END AS run, symbol, session_date, n FROM ({SQL['records_long']})")
def _(spark, sf):
    """Feature records of two runs, the second written twice, as the store holds them."""
    r = ft.records(_feats(spark, sf)).withColumn("odd", F.dayofmonth(F.col("session_date").cast("date")) % 2)
    folder = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    for run, odd in (("even", 0), ("odd", 1), ("odd", 1)):
        store.append_records(r.where(F.col("odd") == odd).drop("odd"), folder, run)
    return store.stored_records(spark, folder).groupBy("run", "symbol", "session_date").agg(F.count("*").alias("n"))


# -- row checks --------------------------------------------------------------------------------------------


@query("val_bar", f"WITH {O.BARS}, x AS (SELECT symbol, os, CASE WHEN slot % 17 = 0 THEN h + 1 ELSE o END AS o, CASE WHEN slot % 13 = 0 THEN l - 1 ELSE h END AS h, l, CASE WHEN slot % 19 = 0 THEN l - 1 ELSE c END AS c, CASE WHEN slot % 23 = 0 THEN -v ELSE v END AS v FROM (SELECT *, os // 1800 AS slot FROM bars)) SELECT symbol, os, CASE WHEN h < l THEN 'high_below_low' WHEN o NOT BETWEEN l AND h THEN 'open_outside' WHEN c NOT BETWEEN l AND h THEN 'close_outside' WHEN v < 0 THEN 'negative_volume' ELSE '' END AS fault FROM x")
def _(spark, sf):
    b = src.bars_from_events(spark, sf).withColumn("slot", F.expr(f"os div {src.INTERVAL}"))
    b = b.selectExpr("symbol", "os", "if(slot % 17 = 0, h + 1, o) as o", "if(slot % 13 = 0, l - 1, h) as h", "l", "if(slot % 19 = 0, l - 1, c) as c", "if(slot % 23 = 0, -v, v) as v")
    return b.select("symbol", "os", ck.bar_fault().alias("fault"))


@query("val_trade", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 OR l_extendedprice IS NULL THEN 'no_price' WHEN l_quantity - 3 <= 0 THEN 'no_size' ELSE '' END AS fault FROM lineitem")
def _(spark, sf):
    x = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "if(l_linenumber = 7, null, l_extendedprice) as price", "l_quantity - 3 as size")
    return x.selectExpr("l_orderkey", "l_linenumber", "case when price is null then 'no_price' when size is null or size <= 0 then 'no_size' else '' end as fault")


@query("val_clock", f"WITH {O.TAPE}, x AS (SELECT event_id, t, t + (event_id % 900 - 600) * 1000000 AS captured FROM tape) SELECT event_id, t - captured <= 300000000 AS ok FROM x")
def _(spark, sf):
    """An observation may lie at most five minutes after its capture; the capture clock is off by what the id says."""
    e = src.events(spark, sf).withColumn("captured", F.expr("t + (event_id % 900 - 600) * 1000000"))
    return e.select("event_id", (F.col("t") - F.col("captured") <= 300_000_000).alias("ok"))


_ARRIVAL = "event_id * 10 + CASE WHEN event_id % 5 = 0 THEN 75 ELSE 0 END"


@query("val_order", f"WITH e AS (SELECT event_type, {_ARRIVAL} AS arrival, epoch_us(ts) // 60000000 AS t FROM events), a AS (SELECT event_type, t, lag(t) OVER (PARTITION BY event_type ORDER BY arrival) AS was FROM e) SELECT event_type AS symbol, count(*) FILTER (t < was) AS backwards, count(*) FILTER (t = was) AS repeated FROM a GROUP BY 1")
def _(spark, sf):
    """Minutes of the tape in an order of arrival in which every fifth event comes late."""
    e = src.events(spark, sf).withColumn("minute", F.expr("t div 60000000")).withColumn("arrival", F.expr(_ARRIVAL))
    return ck.order_faults(e, "symbol", "arrival", "minute")


@query("val_pooled", f"WITH {O.SESS} SELECT coalesce(symbol, '*') AS symbol, session_date, count(*) > 48 AS pooled FROM sess GROUP BY GROUPING SETS ((symbol, session_date), (session_date))")
def _(spark, sf):
    """More bars in a session than a day has slots (48): several instruments under one name, as all symbols together are."""
    n = _bars(spark, sf).groupBy("symbol", "session_date").agg(F.count("*").alias("n"))
    every = n.groupBy("session_date").agg(F.sum("n").alias("n")).select(F.lit("*").alias("symbol"), "session_date", "n")
    return n.unionByName(every).select("symbol", "session_date", (F.col("n") > 48).alias("pooled"))


@query("val_instrument", "SELECT p_partkey, CASE WHEN coalesce(trim(p_name), '') = '' THEN 'no_symbol' WHEN p_size % 7 = 0 THEN 'no_product' WHEN p_size % 9 = 0 THEN 'no_tick' ELSE '' END AS fault FROM part")
def _(spark, sf):
    x = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", "p_name as symbol", "if(p_size % 7 = 0, '', p_brand) as product", "p_size % 9 as tick")
    return x.selectExpr("p_partkey", "case when coalesce(trim(symbol), '') = '' then 'no_symbol' when coalesce(trim(product), '') = '' then 'no_product' when tick is null or tick <= 0 then 'no_tick' else '' end as fault")


@query("val_avail", f"WITH {O.EVS} SELECT symbol, ce, side, mid_os + 1800 <= ce - 1800 * ((ce // 1800) % 3) AS ok FROM gaps")
def _(spark, sf):
    """What rests on a bar may not be available before that bar has closed; the claim is early by what the bar's number says."""
    claimed = F.expr(f"ce - {src.INTERVAL} * ((ce div {src.INTERVAL}) % 3)")
    return ft.gaps(_feats(spark, sf)).select("symbol", "ce", "side", (F.col("mid_os") + src.INTERVAL <= claimed).alias("ok"))


@query("val_partitions", "WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate AS lo, s.hi FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS hi FROM lineitem GROUP BY l_orderkey) s ON o_orderkey = l_orderkey), u AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM r) SELECT o_custkey, count(*) AS n, count(*) FILTER (hi < lo) AS backwards, count(*) FILTER (lo <= until) AS overlapping FROM u GROUP BY o_custkey")
def _(spark, sf):
    """Ranges from order to last shipment of each customer: ordered ends, no overlap."""
    last = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("hi"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("lo"))
    return ck.overlaps(o.join(last, F.col("o_orderkey") == F.col("l_orderkey")), "o_custkey", "lo", "hi", "o_orderkey")


_STAGED = "CASE o_orderpriority WHEN '1-URGENT' THEN 'market_observation' WHEN '2-HIGH' THEN 'feature' WHEN '3-MEDIUM' THEN 'research' WHEN '4-NOT SPECIFIED' THEN 'delivery' ELSE 'guess' END"


@query("val_artifact", f"WITH a AS (SELECT o_orderkey AS id, {_STAGED} AS stage, CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'run' || o_custkey END AS run_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS observed_at, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS captured_at FROM orders) SELECT id, stage, CASE WHEN stage = 'guess' THEN 'unknown_stage' WHEN run_id = '' THEN 'no_run' WHEN stage = 'market_observation' AND (observed_at IS NULL OR captured_at IS NULL) THEN 'no_times' WHEN stage <> 'market_observation' AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'no_parent' ELSE '' END AS fault FROM a")
def _(spark, sf):
    """Orders as artifacts, returned lines as what they were derived from."""
    a = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey as id", f"{_STAGED} as stage", "if(o_custkey % 11 = 0, '', concat('run', o_custkey)) as run_id", "if(o_orderstatus <> 'P', o_orderdate, null) as observed_at", "if(o_orderkey % 13 <> 0, o_orderdate, null) as captured_at")
    edges = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("child"), F.col("l_partkey").alias("parent"))
    return ck.artifact_faults(a, edges)


#: The older gate for this tape: 48 half-hour bars a day.
_OLD = {"expected": 48, "min_bars": 12, "max_missing": 0.25, "min_volume": 100, "max_zero": 0.3, "max_move": 2.5}


@query("a_old_gate", f"""WITH {O.SESS}, x AS (SELECT symbol, session_date, h - l AS r, CASE WHEN (os // 1800) % 97 = 0 THEN os - 1800 ELSE os END AS moment, CASE WHEN (os // 1800) % 89 = 0 THEN os - 10000 ELSE os END AS arrival, CASE WHEN (os // 86400) % 5 = 0 AND (os // 1800) % 2 = 0 THEN 0 ELSE v END AS v FROM sess),
y AS (SELECT *, moment < lag(moment) OVER (PARTITION BY symbol, session_date ORDER BY arrival) AS back FROM x),
g AS (SELECT symbol, session_date, count(*) AS n, sum(v) AS volume, count(*) FILTER (v = 0) AS zero, max(r) AS top, list_sort(list(r))[count(*) // 2 + 1] AS mid, count(DISTINCT moment) AS times, count(*) FILTER (back) AS back FROM y GROUP BY ALL)
SELECT symbol, session_date, concat_ws(',', CASE WHEN n < 12 THEN 'min_bars' END, CASE WHEN greatest(0, 48 - n) / 48 > 0.25 THEN 'max_missing_fraction' END, CASE WHEN volume < 100 THEN 'min_total_volume' END, CASE WHEN zero / n > 0.3 THEN 'max_zero_volume_fraction' END, CASE WHEN mid > 0 AND top / mid > 2.5 THEN 'max_single_bar_move_atr' END, CASE WHEN times < n THEN 'duplicate_timestamps' END, CASE WHEN back > 0 THEN 'out_of_order' END) AS reasons FROM g""")
def _(spark, sf):
    """Repeated times, late arrivals and bars without volume are planted by the number of a bar's slot."""
    b = _bars(spark, sf).selectExpr("symbol", "session_date", "h", "l", "if((os div 1800) % 97 = 0, os - 1800, os) as at", "if((os div 1800) % 89 = 0, os - 10000, os) as arrival", "if((os div 86400) % 5 = 0 and (os div 1800) % 2 = 0, 0, v) as v")
    return ql.fixed_count_gate(b, **_OLD)


# -- digests -----------------------------------------------------------------------------------------------

_DIGEST = (
    O.SESS
    + """,
dg AS (SELECT symbol, session_date, sha256(string_agg('{"c":' || c || ',"h":' || h || ',"l":' || l || ',"o":' || o || ',"os":' || os || ',"v":' || v || '}', chr(10) ORDER BY os)) AS digest FROM sess GROUP BY ALL)"""
)


@query("a_digest", f"WITH {_DIGEST} SELECT * FROM dg")
def _(spark, sf):
    return ck.digests(_bars(spark, sf))


@query("a_hash_chain", f"WITH {_DIGEST} SELECT symbol, count(*) AS links, list_reduce(list_prepend('', list(digest ORDER BY session_date)), lambda a, b: sha256(a || b)) AS head FROM dg GROUP BY symbol")
def _(spark, sf):
    return ck.chain(ck.digests(_bars(spark, sf)))


# -- continuity over sessions that pass, eligibility -------------------------------------------------------

_CONT = (
    ", k0 AS (SELECT symbol, session_date, string_agg(DISTINCT contract_id, ',' ORDER BY contract_id) AS contract_ids, count(DISTINCT contract_id) AS n_contracts, count(*) FILTER (contract_id IS NULL) AS n_missing FROM sess GROUP BY ALL),"
    """
k1 AS (SELECT k0.*, last_value(CASE WHEN exclusions = '' THEN session_date END IGNORE NULLS) OVER w AS prior_session FROM k0 JOIN q5 USING (symbol, session_date) WINDOW w AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k2 AS (SELECT a.symbol, a.session_date, a.prior_session, a.contract_ids, CASE WHEN a.n_missing > 0 OR a.n_contracts = 0 THEN 'unknown_provenance' WHEN a.n_contracts > 1 THEN 'mixed_session' WHEN a.prior_session IS NULL THEN 'no_prior_session' WHEN b.n_missing > 0 OR b.n_contracts = 0 THEN 'unknown_provenance' WHEN b.n_contracts > 1 THEN 'mixed_session' WHEN b.contract_ids <> a.contract_ids THEN 'contract_boundary' ELSE 'same_contract' END AS verdict
  FROM k1 a LEFT JOIN k0 b ON b.symbol = a.symbol AND b.session_date = a.prior_session)"""
)


def _verdicts(f):
    passed = ql.quality(f, **TAPE).where("passed").select("symbol", "session_date")
    return ql.continuity(ql.contracts(f), passed)


@query("a_continuity", f"WITH {_QUALITY}{_CONT} SELECT * FROM k2")
def _(spark, sf):
    return _verdicts(_feats(spark, sf))


@query("a_continuity_summary", f"WITH {_QUALITY}{_CONT} SELECT symbol, verdict, count(*) AS n FROM k2 GROUP BY ALL")
def _(spark, sf):
    return _verdicts(_feats(spark, sf)).groupBy("symbol", "verdict").agg(F.count("*").alias("n"))


#: Events that read levels of the prior session, and so need its contract.
PRIOR = ("sweep_high", "sweep_low")


@query("j_eligible", f"WITH {O.EVS}{_QUALITY.removeprefix(O.FEATS)}{_CONT} SELECT e.symbol, e.ce, e.event FROM evs e LEFT JOIN k2 USING (symbol, session_date) WHERE e.event NOT IN {PRIOR} OR verdict = 'same_contract'")
def _(spark, sf):
    """Events that may be studied: those that read the prior session only where it has the same contract, others always."""
    f = _feats(spark, sf)
    e, prior = ft.all_events(f).select("symbol", "session_date", "ce", "event"), F.col("event").isin(*PRIOR)
    same = _verdicts(f).where("verdict = 'same_contract'").select("symbol", "session_date")
    return e.where(~prior).unionByName(e.where(prior).join(same, ["symbol", "session_date"], "left_semi").select(e.columns)).select("symbol", "ce", "event")


# -- means and their resampled intervals -------------------------------------------------------------------


@query("i_boot_mean", f"WITH {_OBS}, {boot_sql('obs', ['hypothesis'])} SELECT hypothesis, round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high FROM boot")
def _(spark, sf):
    b = inf.bootstrap_mean(_observations(spark, sf), ["hypothesis"], "signed", rounds=2000)
    return b.select("hypothesis", F.round("ci_low", 4).alias("ci_low"), F.round("ci_high", 4).alias("ci_high"))

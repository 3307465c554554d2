"""Queries of ingest, contracts, request state and enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.checks import views
from tarmac.checks.registry import query
from tarmac.checks.views import with_views
from tarmac.functions.text import redact_map, redact_url, schedule_url, weather_url
from tarmac.operators import contracts, state
from tarmac.operators.clean import clean_airports, clean_flights, one_per_code
from tarmac.operators.enrich import Attempt, Reply, RetryPolicy, TransportError, enrich, retry_decision
from tarmac.operators.features import dataset_rows, newest_responses, weather_values
from tarmac.plans import ingest
from tarmac.sources.csv import AIRPORT_COLUMNS, malformed_lines, read_airports, read_flights
from tarmac.sources.scratch import scratch_path, stage
from tarmac.sources.warehouse import Warehouse, describe, table_counts
from tarmac.streaming.drain import drain_arrivals
from tarmac.streaming.leases import watch_leases

FLIGHTS_SQL = with_views("SELECT * FROM flights", "flights")
AIRPORTS_SQL = """
    SELECT c_name AS name, CAST((c_custkey % 181) - 90 AS DOUBLE) AS lat,
        CAST((c_custkey % 361) - 180 AS DOUBLE) AS long,
        'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS code
    FROM customer WHERE c_custkey % 4 <> 1"""


@query(FLIGHTS_SQL)
def flights_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.flights(spark, sf_dir)


@query(AIRPORTS_SQL)
def airports_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_airports(views.raw_airports(spark, sf_dir))


@query(FLIGHTS_SQL)
def flights_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "flights-csv")
    views.raw_flights(spark, sf_dir).write.csv(path, header=True)
    return clean_flights(read_flights(spark, path))


@query(AIRPORTS_SQL)
def airports_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "airports-csv")
    extra = F.lit("unused").alias("continent")
    views.raw_airports(spark, sf_dir).select("*", extra).write.csv(path, header=True)
    return clean_airports(read_airports(spark, path))


CSV_PARTS = 4


@query("""
    SELECT CAST(o_custkey AS VARCHAR) AS code, o_orderpriority AS name, CAST(NULL AS VARCHAR) AS line FROM orders WHERE o_orderkey % 10 > 1
    UNION ALL SELECT NULL, NULL, '"' || o_orderpriority || '",1.5,' || CASE WHEN o_orderkey % 10 = 0 THEN '2' ELSE '2,' || o_custkey || ',9' END
    FROM orders WHERE o_orderkey % 10 < 2""")
def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good rows and, apart, the raw text of lines with too few or too many fields."""
    path = scratch_path(spark, "ragged-csv")
    order = F.col("o_orderkey")
    front = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('",1.5,2'))
    code = F.concat(F.lit(","), F.col("o_custkey").cast("string"))
    line = F.when(order % 10 == 0, front).when(order % 10 == 1, F.concat(front, code, F.lit(",9"))).otherwise(F.concat(front, code))
    lines = views.read(spark, sf_dir, "orders").select(F.pmod(F.xxhash64(order), F.lit(CSV_PARTS)).alias("part"), order.alias("at"), line.alias("value"))
    header = spark.range(CSV_PARTS).selectExpr("id AS part", "-1L AS at", "'name,latitude_deg,longitude_deg,iata_code' AS value")
    lines.unionByName(header).repartition("part").sortWithinPartitions("part", "at").drop("at").write.partitionBy("part").text(path)
    files = f"{path}/part=*/*.txt"
    good = read_airports(spark, files).select(F.col("iata_code").alias("code"), "name", F.lit(None).cast("string").alias("line"))
    bad = malformed_lines(spark, files, AIRPORT_COLUMNS)
    return good.unionByName(bad.select(F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("name"), "line"))


@query(FLIGHTS_SQL)
def published_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    flights = views.flights(spark, sf_dir)
    warehouse.publish("flight_data", flights.where(F.col("month") == 1), contracts.FLIGHTS)
    warehouse.publish("flight_data", flights, contracts.FLIGHTS, partition_by=("year", "month"))
    return contracts.check_schema(warehouse.table("flight_data"), contracts.FLIGHTS)


@query(with_views("""
    SELECT 'flight_data' AS table_name, count(*) AS row_count FROM flights
    UNION ALL SELECT 'airport_data', count(*) FROM airports
    UNION ALL SELECT 'weather_req_table', count(*) FROM requests
    UNION ALL SELECT 'weather_response_raw', count(*) FROM newest_events
    UNION ALL SELECT 'model_dataset', count(*) FROM dataset""", "airports", "requests", "dataset"))
def table_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = newest_responses(views.responses(spark, sf_dir))
    flights = views.flights(spark, sf_dir)
    return table_counts({
        "flight_data": flights,
        "airport_data": views.airports(spark, sf_dir),
        "weather_req_table": views.requests(spark, sf_dir),
        "weather_response_raw": newest,
        "model_dataset": dataset_rows(flights, weather_values(newest)),
    })


@query(with_views("SELECT * FROM requests", "requests"))
def request_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.requests(spark, sf_dir).drop("updated_at")


@query(with_views("""
    SELECT 'flight_data' AS table_name, c.check_name, s.total AS total_rows, c.failing AS failing_rows,
        c.failing = 0 AS passed
    FROM (SELECT count(*) AS total FROM flights) s, (VALUES ('not_empty', CAST(0 AS BIGINT)),
        ('required_not_null', 0), ('not_null_date', 0), ('not_null_flight_number', 0),
        ('not_null_origin', 0), ('not_null_dest', 0)) c(check_name, failing)
    UNION ALL
    SELECT 'airport_data', c.check_name, s.total, c.failing, c.failing = 0
    FROM (SELECT count(*) AS total, count(*) FILTER (WHERE c_custkey % 4 = 1) AS bad FROM customer) s,
        LATERAL (VALUES ('not_empty', CAST(0 AS BIGINT)), ('required_not_null', s.bad), ('not_null_name', 0),
            ('not_null_lat', 0), ('not_null_long', 0), ('not_null_code', s.bad)) c(check_name, failing)""",
    "flights"))
def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    unfiltered = views.raw_airports(spark, sf_dir).select(
        "name", F.col("latitude_deg").cast("double").alias("lat"),
        F.col("longitude_deg").cast("double").alias("long"), F.col("iata_code").alias("code"),
    )
    return contracts.contract_report(views.flights(spark, sf_dir), contracts.FLIGHTS).unionByName(
        contracts.contract_report(unfiltered, contracts.AIRPORTS)
    )


@query(with_views(
    "SELECT code, date, count(*) AS row_count FROM weather_events GROUP BY code, date HAVING count(*) > 1",
    "weather_events"))
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.key_violations(views.responses(spark, sf_dir), contracts.WEATHER_RAW.key)


@query(with_views("SELECT code, date, event_id AS seq FROM newest_events", "newest_events"))
def raw_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_responses(views.responses(spark, sf_dir)).select("code", "date", "seq")


@query(with_views("""
    SELECT date, code, name, lat, long FROM requests r
    WHERE NOT EXISTS (SELECT 1 FROM weather_events w WHERE w.date = r.date AND w.code = r.code)""",
    "requests", "weather_events"))
def pending_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = state.outstanding(views.requests(spark, sf_dir), views.responses(spark, sf_dir))
    return todo.select("date", "code", "name", "lat", "long")


@query(with_views("""
    SELECT date, code FROM requests r
    WHERE EXISTS (SELECT 1 FROM weather_events w WHERE w.date = r.date AND w.code = r.code)""",
    "requests", "weather_events"))
def done_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.answered(views.requests(spark, sf_dir), views.responses(spark, sf_dir)).select("date", "code")


@query(with_views("""
    SELECT c_custkey, code, code IN (SELECT code FROM requests) AS known
    FROM (SELECT c_custkey, 'N' || lpad(CAST(c_custkey % 40 AS VARCHAR), 2, '0') AS code FROM customer)""",
    "requests"))
def airport_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.read(spark, sf_dir, "customer").select(
        "c_custkey", views.code(F.col("c_custkey") % 40).alias("code")
    )
    return state.with_membership(asked, "code", views.requests(spark, sf_dir), "known").select("c_custkey", "code", "known")


@query(with_views("""
    SELECT date, code, 'in_progress' AS status, attempt_count + 1 AS attempt_count
    FROM requests ORDER BY date, code LIMIT 50""", "requests"))
def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = state.open_log(views.requests(spark, sf_dir))
    return state.claim_batch(opened, views.now(), 50).select("date", "code", "status", "attempt_count")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one transition of its airport day."""
    k = F.get_json_object("props", "$.k").cast("int")
    return views.read(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("date"), views.code(F.col("user_id") % 23).alias("code"),
        F.element_at(F.array(*map(F.lit, ("pending", "in_progress", "failed", "done"))), k % 4 + 1).alias("status"),
        F.nullif(k % 5, F.lit(4)).alias("attempt_count"),
        F.when(k % 4 == 2, F.concat(F.lit("error "), k.cast("string"))).alias("last_error"),
        F.col("ts").cast("timestamp").alias("updated_at"), F.col("event_id").alias("seq"),
    )


LOG_SQL = """
    SELECT date, code, ['pending', 'in_progress', 'failed', 'done'][k % 4 + 1] AS status,
        nullif(k % 5, 4) AS attempt_count,
        CASE WHEN k % 4 = 2 THEN 'error ' || CAST(k AS VARCHAR) END AS last_error, ts AS updated_at, event_id AS seq
    FROM (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY event_id DESC) AS version FROM weather_events)
    WHERE version = 1"""


@query(with_views("SELECT date, code, status, attempt_count, last_error, seq FROM log", "weather_events", log=LOG_SQL))
def queue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current_state(_log(spark, sf_dir)).select(
        "date", "code", "status", "attempt_count", "last_error", "seq"
    )


@query(with_views("""
    SELECT date, code, 'in_progress' AS status, coalesce(attempt_count, 0) + 1 AS attempt_count, last_error, seq + 1 AS seq
    FROM log WHERE status = 'pending'""", "weather_events", log=LOG_SQL))
def claim_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = state.claim_batch(state.current_state(_log(spark, sf_dir)), views.now())
    return claimed.select("date", "code", "status", "attempt_count", "last_error", "seq")


@query(with_views("""
    SELECT date, code, 'pending' AS status, attempt_count, last_error, seq + 1 AS seq
    FROM log WHERE status = 'in_progress' AND updated_at < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 HOUR""",
    "weather_events", log=LOG_SQL))
def reset_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    stale = state.requeue_stale(state.current_state(_log(spark, sf_dir)), now, "1 hour")
    return stale.select("date", "code", "status", "attempt_count", "last_error", "seq")


@query(with_views("""
    SELECT date, code, CASE WHEN status = 'failed' THEN 'failed' ELSE 'done' END AS status,
        CASE WHEN status = 'failed' THEN last_error END AS last_error, seq + 1 AS seq
    FROM log WHERE status IN ('in_progress', 'failed')""", "weather_events", log=LOG_SQL))
def marked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = state.current_state(_log(spark, sf_dir))
    done = state.mark(current.where(F.col("status") == "in_progress"), "done", views.now())
    failed = state.mark(current.where(F.col("status") == "failed"), "failed", views.now(), F.col("last_error"))
    return done.unionByName(failed).select("date", "code", "status", "last_error", "seq")


@query(with_views(f"""
    SELECT date, code, '{views.WEATHER_ADDRESS}?latitude=' || CAST(lat AS VARCHAR) || '&longitude=' || CAST(long AS VARCHAR)
        || '&start_date=' || CAST(date AS VARCHAR) || '&end_date=' || CAST(date AS VARCHAR)
        || '&daily={"%2C".join(views.WEATHER_FIELDS)}&timezone=auto' AS weather_url,
        'https://schedule.example/v1?type=departure&date=' || CAST(date AS VARCHAR) || '&iataCode=' || code AS schedule_url
    FROM requests""", "requests"))
def request_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.requests(spark, sf_dir)
    return rows.select(
        "date", "code",
        weather_url(views.WEATHER_ADDRESS, F.col("lat"), F.col("long"), F.col("date")).alias("weather_url"),
        schedule_url("https://schedule.example/v1", F.col("date"), F.col("code")).alias("schedule_url"),
    )


@query("""
    SELECT page_id,
        regexp_replace(address, '(access_key|apikey)[^&]*', '\\1=REDACTED', 'g') AS redacted_url,
        'REDACTED' AS header_key, 'text/html' AS header_type
    FROM (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '&apikey=' ELSE '&access_key=' END
        || CAST(page_id * 7919 AS VARCHAR) || CASE WHEN page_id % 3 = 0 THEN '&lang=en' ELSE '' END AS address
        FROM pages)""")
def redact_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    address = F.concat(
        F.col("url"), F.when(page % 2 == 0, "&apikey=").otherwise("&access_key="), (page * 7919).cast("string"),
        F.when(page % 3 == 0, "&lang=en").otherwise(""),
    )
    headers = F.create_map(F.lit("apikey"), (page * 7919).cast("string"), F.lit("content-type"), F.lit("text/html"))
    return views.read(spark, sf_dir, "pages").select(
        "page_id", redact_url(address).alias("redacted_url"), redact_map(headers).alias("headers")
    ).select(
        "page_id", "redacted_url", F.col("headers")["apikey"].alias("header_key"),
        F.col("headers")["content-type"].alias("header_type"),
    )


def fake_fetch(url: str, attempt: Attempt) -> Reply:
    """Stands in for a provider: the reply depends only on the address and the attempt."""
    day = int(url.split("start_date=")[1][8:10])
    if day % 7 == 1 and attempt.number == 0:
        return Reply(429, "slow down")
    if day % 7 == 2:
        if attempt.number == 1:
            raise TimeoutError(f"no answer in {attempt.timeout_seconds:g} s")
        return Reply(503, "overloaded")
    if day == 28:
        raise KeyError("daily")
    if day % 7 == 3:
        raise TransportError("connection reset")
    if day % 7 == 4:
        return Reply(404, "no such day")
    if day % 7 == 5:
        return Reply(200, "[1, 2]")
    if day % 7 == 6:
        return Reply(200, "plain text")
    return Reply(200, '{"daily": {"weather_code": [%d]}}' % day)


NO_WAIT = RetryPolicy(sleep=lambda seconds: None)
FETCH_SQL = """
    SELECT date, code, day(date) % 7 NOT IN (2, 3, 4) AND day(date) <> 28 AS ok,
        CASE WHEN day(date) = 28 THEN NULL ELSE CASE day(date) % 7 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN '{"data": [1, 2]}'
            WHEN 6 THEN '{"content": "plain text"}'
            ELSE '{"daily": {"weather_code": [' || CAST(day(date) AS VARCHAR) || ']}}' END END AS payload,
        CAST(CASE WHEN day(date) <> 28 THEN CASE day(date) % 7 WHEN 2 THEN 503 WHEN 3 THEN 408 WHEN 4 THEN 404 ELSE 200 END END AS INTEGER) AS status_code,
        CASE WHEN day(date) = 28 THEN 'KeyError: ' || chr(39) || 'daily' || chr(39) ELSE CASE day(date) % 7
            WHEN 2 THEN 'overloaded' WHEN 3 THEN 'connection reset' WHEN 4 THEN 'no such day' END END AS error,
        CAST(CASE WHEN day(date) = 28 THEN 1 ELSE CASE day(date) % 7 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 1 END END AS INTEGER) AS attempts
    FROM requests"""


@query(with_views(FETCH_SQL, "requests"))
def enrich_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(views.requests(spark, sf_dir), views.WEATHER_ADDRESS, fake_fetch, NO_WAIT).drop("api_url")


@query(with_views("""
    SELECT count(*) AS queued, count(*) AS claimed, count(*) AS fetched, count(*) FILTER (WHERE ok) AS written,
        count(*) FILTER (WHERE NOT ok) AS failed_fetch, CAST(0 AS BIGINT) AS failed_write
    FROM fetched""", "requests", fetched=FETCH_SQL))
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.run_stats(enrich(views.requests(spark, sf_dir), views.WEATHER_ADDRESS, fake_fetch, NO_WAIT))


class _Unsteady(Warehouse):
    """Its second append of responses fails."""

    appends = 0

    def append(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        if name.startswith(ingest.RESPONSES):
            self.appends += 1
            if self.appends == 2:
                raise OSError("no space left")
        super().append(name, df, partition_by)


@query(with_views("""
    SELECT count(*) AS queued, count(*) AS claimed, count(*) AS fetched, count(*) FILTER (WHERE ok AND turn // size <> 1) AS written,
        count(*) FILTER (WHERE NOT ok) AS failed_fetch, count(*) FILTER (WHERE ok AND turn // size = 1) AS failed_write
    FROM (SELECT ok, row_number() OVER (ORDER BY date, code) - 1 AS turn, greatest(1, count(*) OVER () // 3) AS size FROM fetched)""",
    "requests", fetched=FETCH_SQL))
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drain in portions whose second one cannot store its responses."""
    opened = _open_warehouse(spark, sf_dir)
    size = max(1, ingest.request_log(opened).count() // 3)
    return ingest.drain(_Unsteady(spark, opened.root), views.WEATHER_ADDRESS, fake_fetch, NO_WAIT, batch_size=size)


@query(with_views(FETCH_SQL, "requests"))
def enrich_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the lookups were stored by a run that broke off; the second run finds them and asks for the rest."""
    requests, folder = views.requests(spark, sf_dir), scratch_path(spark, "portions")
    stage(enrich(requests.where("day(date) % 2 = 0"), views.WEATHER_ADDRESS, fake_fetch, NO_WAIT, partitions=4, portions=folder), "broken-off")
    return enrich(requests, views.WEATHER_ADDRESS, fake_fetch, NO_WAIT, partitions=4, portions=folder).drop("api_url")


@query("""
    SELECT event_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'done'
        WHEN (status IS NULL OR status IN (408, 429, 500, 502, 503, 504)) AND attempt < 2 THEN 'retry'
        ELSE 'failed' END AS decision
    FROM (SELECT event_id, [200, 204, 301, 404, 408, 429, 500, 501, 502, 503, 504, NULL][event_id % 12 + 1] AS status,
        event_id // 12 % 3 AS attempt FROM events)""")
def retry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    codes = F.array(*[F.lit(c).cast("int") for c in (200, 204, 301, 404, 408, 429, 500, 501, 502, 503, 504, None)])
    status = F.get(codes, (event % 12).cast("int"))
    return views.read(spark, sf_dir, "events").select(
        "event_id", retry_decision(status, F.floor(event / 12) % 3).alias("decision")
    )


def _open_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    requests = warehouse.publish("weather_req_table", views.requests(spark, sf_dir), contracts.WEATHER_REQUESTS)
    ingest.append_log(warehouse, state.open_log(requests))
    return warehouse


BACKFILL_SQL = with_views("""
    SELECT date, code, CASE WHEN ok THEN 'done' ELSE 'failed' END AS status, CAST(1 AS INTEGER) AS attempt_count,
        error AS last_error, payload
    FROM fetched""", "requests", fetched=FETCH_SQL)


def _backfilled(warehouse: Warehouse, log: DataFrame) -> DataFrame:
    stored = newest_responses(ingest.responses(warehouse)).select("date", "code", "payload")
    return state.current_state(log).join(stored, ["date", "code"], "left").select(
        "date", "code", "status", "attempt_count", "last_error", "payload"
    )


@query(BACKFILL_SQL)
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = _open_warehouse(spark, sf_dir)
    ingest.backfill(warehouse, views.WEATHER_ADDRESS, fake_fetch, NO_WAIT)
    return _backfilled(warehouse, ingest.request_log(warehouse))


@query(BACKFILL_SQL)
def drain_arrivals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    warehouse.publish("weather_req_table", views.requests(spark, sf_dir), contracts.WEATHER_REQUESTS)
    arrivals = scratch_path(spark, "arrivals")
    for half in (0, 1):
        part = views.requests(spark, sf_dir).where(F.dayofmonth("date") % 2 == half)
        part.write.mode("append").parquet(arrivals)
        run = drain_arrivals(
            warehouse, arrivals, f"{warehouse.root}/_checkpoint", views.WEATHER_ADDRESS, fake_fetch, NO_WAIT
        )
        run.awaitTermination()
    return _backfilled(warehouse, ingest.request_log(warehouse))


STATES_SQL = with_views("""
    SELECT date, code, CASE WHEN day(date) % 5 = 0 THEN 'failed' WHEN day(date) % 5 = 1 THEN 'in_progress' WHEN ok THEN 'done' ELSE 'failed' END AS status,
        CAST(CASE WHEN day(date) % 5 = 4 THEN 1 ELSE 1 + (day(date) % 5 = 2)::INT END AS INTEGER) AS attempt_count,
        CASE WHEN day(date) % 5 = 0 THEN 'given up' WHEN day(date) % 5 = 1 THEN NULL ELSE error END AS last_error,
        CAST(CASE WHEN day(date) % 5 = 0 THEN 2 WHEN day(date) % 5 = 1 THEN 1 WHEN day(date) % 5 = 2 THEN 4 WHEN day(date) % 5 = 3 THEN 2 ELSE 2 END AS BIGINT) AS seq,
        CASE WHEN day(date) % 5 IN (0, 1) THEN NULL ELSE payload END AS payload
    FROM fetched""", "requests", fetched=FETCH_SQL)


@query(STATES_SQL)
def arrivals_meet_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request arrives twice: keys that failed or are claimed stay, requeued ones go on, the rest are opened."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    requests = warehouse.publish("weather_req_table", views.requests(spark, sf_dir), contracts.WEATHER_REQUESTS)
    opened, day, now = state.open_log(requests), F.dayofmonth("date") % 5, F.current_timestamp()
    ingest.append_log(warehouse, opened.where(day < 4))
    claimed = stage(state.claim_batch(opened.where(day < 3), now), "claimed")
    ingest.append_log(warehouse, claimed)
    ingest.append_log(warehouse, state.mark(claimed.where(day == 0), "failed", now, F.lit("given up")))
    ingest.append_log(warehouse, state.requeue_stale(claimed.where(day == 2), now + F.expr("INTERVAL 1 HOUR"), "1 minute"))
    arrivals = scratch_path(spark, "arrivals")
    for _ in range(2):
        requests.write.mode("append").parquet(arrivals)
        drain_arrivals(warehouse, arrivals, f"{warehouse.root}/_checkpoint", views.WEATHER_ADDRESS, fake_fetch, NO_WAIT,
                       lease="1 day").awaitTermination()
    stored = newest_responses(ingest.responses(warehouse)).select("date", "code", "payload")
    return state.current_state(ingest.request_log(warehouse)).join(stored, ["date", "code"], "left").select(
        "date", "code", "status", "attempt_count", "last_error", "seq", "payload")


@query(BACKFILL_SQL)
def drained_in_portions(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = _open_warehouse(spark, sf_dir)
    size = max(1, ingest.request_log(warehouse).count() // 3)
    ingest.drain(warehouse, views.WEATHER_ADDRESS, fake_fetch, NO_WAIT, batch_size=size)
    return _backfilled(warehouse, ingest.request_log(warehouse))


def _logged(spark: SparkSession, sf_dir: str) -> tuple[Warehouse, DataFrame]:
    """A warehouse, and every event as a row of its request log."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    requests = warehouse.publish("weather_req_table", views.requests(spark, sf_dir), contracts.WEATHER_REQUESTS)
    place = {"name": F.col("code"), "lat": F.lit(0.0), "long": F.lit(0.0)}
    return warehouse, _log(spark, sf_dir).withColumns(place).select(*requests.columns, "seq")


@query(with_views("""
    SELECT date, code, CASE WHEN over THEN 'pending' ELSE status END AS status, attempt_count, last_error, seq + over::INT AS seq,
        epoch_us(CASE WHEN over THEN updated_at + INTERVAL 6 HOUR ELSE updated_at END) AS updated_us
    FROM (SELECT *, status = 'in_progress' AND updated_at + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) AS over FROM log)""",
    "weather_events", log=LOG_SQL))
def leases_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose lease the newest event has outlived are back in the queue; timers return them, no later row of theirs."""
    warehouse, log = _logged(spark, sf_dir)
    ingest.append_log(warehouse, log)
    watch_leases(warehouse, f"{warehouse.root}/_leases", 6 * 3600, "event", trigger={"availableNow": True}).awaitTermination()
    return ingest.request_state(warehouse).select("date", "code", "status", "attempt_count", "last_error", "seq", F.unix_micros("updated_at").alias("updated_us"))


@query(with_views("SELECT date, code, status, attempt_count, last_error, seq FROM log", "weather_events", log=LOG_SQL))
def compacted_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log comes in four parts that do not follow its order, with snapshots between them and a tail behind the last."""
    warehouse, log = _logged(spark, sf_dir)
    for part in range(4):
        ingest.append_log(warehouse, log.where(F.col("seq") % 4 == part))
        if part in (0, 2):
            ingest.compact_state(warehouse)
    return ingest.request_state(warehouse).select("date", "code", "status", "attempt_count", "last_error", "seq")


@query(with_views("SELECT c.column_name, c.column_type, n FROM (SELECT count(*) AS n FROM flights), (VALUES " + ", ".join(
    f"('{name}', '{kind}')" for name, kind in zip(contracts.FLIGHTS.names, (
        "date", "int", "int", "int", "int", "double", "string", "string", "string", "string", "bigint", "bigint", "double", "double", "double"))
) + ") c(column_name, column_type)", "flights"))
def described_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a published, partitioned table as it is read back, with its recorded number of rows."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    warehouse.publish("flight_data", views.flights(spark, sf_dir), contracts.FLIGHTS, partition_by=("year", "month"))
    return describe(warehouse.table("flight_data")).withColumn("n", F.lit(ingest.audit(warehouse).first().row_count).cast("bigint"))


@query(with_views("""
    SELECT 'weather_response_raw has ' || count(*) || ' keys [''code'', ''date''] in more than one row' AS refusal
    FROM (SELECT 1 FROM weather_events GROUP BY code, date HAVING count(*) > 1)""", "weather_events"))
def refused_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that repeats its key is not published; the refusal says how many keys are repeated."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    stored = views.responses(spark, sf_dir).withColumn("api_url", F.lit("https://provider.example"))
    try:
        warehouse.publish("weather_response_raw", stored.select(*contracts.WEATHER_RAW.names), contracts.WEATHER_RAW)
        refusal = None
    except contracts.ContractBroken as broken:
        refusal = str(broken)
    return warehouse.current().where("false").select("name").unionByName(
        spark.range(1).select(F.lit(refusal).cast("string").alias("name"))).withColumnRenamed("name", "refusal")


@query(with_views("""
    SELECT code, min(name) AS name, count(*) AS requests_served
    FROM (SELECT r.code, a.name FROM requests r JOIN airports a ON a.code = r.code) GROUP BY code""",
    "requests", "airports"))
def airport_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    single = one_per_code(views.airports(spark, sf_dir))
    served = views.requests(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("requests_served"))
    return served.join(single, "code").select("code", "name", "requests_served")


# A third of January's flights, and all weather from the 21st on, come after the dataset was built.
LATE_SQL = "month = 1 AND CAST(flight_number AS BIGINT) % 3 = 0"


@query(with_views(f"""
    SELECT {", ".join(name for name in contracts.MODEL_DATASET.names if name != "id")}, month = 2 AS first_file,
        row_number() OVER (PARTITION BY late ORDER BY flight_date, origin, dest, flight_num)
            + CASE WHEN late THEN (SELECT count(*) FROM flights WHERE NOT ({LATE_SQL})) ELSE 0 END AS id
    FROM (SELECT * EXCLUDE (id), {LATE_SQL.replace("flight_number", "flight_num")} AS late FROM dataset)""", "dataset"))
def updated_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New flights and weather of one month: it alone is rebuilt, ids go on, the other month keeps its files (``first_file``)."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    flights, stored = views.flights(spark, sf_dir), views.responses(spark, sf_dir)
    stored = stored.select("code", "date", "api_url", "fetched_at", "payload", "seq")
    late = F.expr("month = 1 AND CAST(flight_number AS BIGINT) % 3 = 0")
    warehouse.publish("weather_req_table", views.requests(spark, sf_dir), contracts.WEATHER_REQUESTS)
    warehouse.publish("flight_data", flights.where(~late), contracts.FLIGHTS)
    ingest.append_responses(warehouse, stored.where(F.dayofmonth("date") <= 20))
    ingest.build_model_dataset(warehouse)
    first = warehouse.version("model_dataset")
    warehouse.extend("flight_data", flights.where(late), contracts.FLIGHTS)
    ingest.append_responses(warehouse, stored.where(F.dayofmonth("date") > 20))
    ingest.update_model_dataset(warehouse, overlap="0 seconds")
    written = F.contains("_metadata.file_path", F.lit(first.path.rsplit("/", 1)[1]))
    return warehouse.files("model_dataset", warehouse.version("model_dataset")).select(
        *contracts.MODEL_DATASET.names, written.alias("first_file"))

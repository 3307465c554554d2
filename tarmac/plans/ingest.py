"""Source files to published tables, request backfill and the model dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators import contracts, state
from tarmac.operators.clean import clean_airports, clean_flights, enrichment_requests
from tarmac.operators.enrich import Attempt, Reply, RetryPolicy, enrich
from tarmac.operators.features import DATASET_NAMES, NATURAL_ORDER, dataset_rows, model_dataset, weather_table
from tarmac.operators.ids import dense_id
from tarmac.plans.counters import RunCounters, counted
from tarmac.sources.csv import AIRPORT_COLUMNS, FLIGHT_COLUMNS, MalformedLines, malformed_lines, read_airports, read_flights
from tarmac.sources.keyed_log import KeyedLog
from tarmac.sources.scratch import stage
from tarmac.sources.warehouse import Warehouse, partition_of

DATASET_PARTS = ("year", "month")
# How Spark names the folder of rows whose partition value is null.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
LOG = "weather_req_log"
RESPONSES = "weather_responses"
RESPONSE_COLUMNS = "code string, date date, api_url string, fetched_at timestamp, payload string, seq bigint"


def _sound(warehouse: Warehouse, name: str, lines: DataFrame, quarantine: bool) -> None:
    """Publish the malformed lines of a source as ``<name>_malformed``, or refuse the source if there are any."""
    if quarantine:
        warehouse.publish(f"{name}_malformed", lines)
    elif not lines.isEmpty():
        raise MalformedLines(f"{name} has lines with another number of fields than its header")


def build_sources(warehouse: Warehouse, flights_csv: str, airports_csv: str, quarantine: bool = False) -> DataFrame:
    """Clean both CSV sources, publish them and open the request log.

    Malformed lines stop the build unless ``quarantine`` asks for them as tables beside the good rows.
    """
    spark = warehouse.spark
    _sound(warehouse, "flight_data", malformed_lines(spark, flights_csv, FLIGHT_COLUMNS), quarantine)
    _sound(warehouse, "airport_data", malformed_lines(spark, airports_csv, AIRPORT_COLUMNS), quarantine)
    flights = warehouse.publish(
        "flight_data", clean_flights(read_flights(spark, flights_csv)), contracts.FLIGHTS, sources=(flights_csv,)
    )
    airports = warehouse.publish(
        "airport_data", clean_airports(read_airports(spark, airports_csv)), contracts.AIRPORTS
    )
    requests = warehouse.publish(
        "weather_req_table", enrichment_requests(flights, airports), contracts.WEATHER_REQUESTS
    )
    known = request_state(warehouse, requests)
    fresh = state.open_log(requests).join(known.select(*state.KEY), list(state.KEY), "left_anti")
    append_log(warehouse, fresh)
    return requests


def _request_log(warehouse: Warehouse) -> KeyedLog:
    schema = state.open_log(warehouse.table("weather_req_table")).schema
    return KeyedLog(warehouse, LOG, schema, state.KEY, ("seq", "updated_at"))


def _response_log(warehouse: Warehouse) -> KeyedLog:
    schema = warehouse.spark.createDataFrame([], RESPONSE_COLUMNS).schema
    return KeyedLog(warehouse, RESPONSES, schema, state.KEY, ("fetched_at", "seq"))


def append_log(warehouse: Warehouse, rows: DataFrame) -> None:
    _request_log(warehouse).append(rows)


def request_log(warehouse: Warehouse, keys: DataFrame | None = None) -> DataFrame:
    """The whole request log, or its rows of the given keys, of which only the months are read."""
    return _request_log(warehouse).rows(keys)


def request_state(warehouse: Warehouse, keys: DataFrame | None = None) -> DataFrame:
    """The newest row of every request, or of the given keys: the snapshot and the log behind it."""
    return _request_log(warehouse).state(keys)


def compact_state(warehouse: Warehouse) -> None:
    """Write snapshots of the requests and the responses, so that later runs no longer read the logs before them."""
    _request_log(warehouse).compact()
    _response_log(warehouse).compact()


def append_responses(warehouse: Warehouse, rows: DataFrame) -> None:
    _response_log(warehouse).append(rows)


def responses(warehouse: Warehouse, keys: DataFrame | None = None) -> DataFrame:
    return _response_log(warehouse).rows(keys)


def store_outcomes(warehouse: Warehouse, claimed: DataFrame, outcomes: DataFrame) -> RunCounters:
    """Append responses, then final states; repeating it changes nothing in the newest rows.

    Responses are stored as a whole. If that fails, their requests end as failed with the error, and the run goes on.
    """
    now = F.current_timestamp()
    arrived = outcomes.where("ok").join(claimed.select(*state.KEY, "seq"), list(state.KEY)).select(
        "code", "date", "api_url", now.alias("fetched_at"), "payload", "seq")
    written, lost = 0, None
    try:
        append_responses(warehouse, arrived)
        written = outcomes.where("ok").count()
    except Exception as error:
        lost = f"response was not stored: {type(error).__name__}"
    results = claimed.join(outcomes.select(*state.KEY, "ok", "error"), list(state.KEY))
    sound = F.col("ok") if lost is None else F.lit(False)
    reason = F.coalesce("error", F.lit(lost or "missing payload"))
    done = state.mark(results.where(sound), "done", now)
    failed = state.mark(results.where(~sound), "failed", now, reason)
    append_log(warehouse, done.unionByName(failed).select(*claimed.columns))
    return RunCounters(written=written, failed_write=0 if lost is None else outcomes.where("ok").count())


def requeue(warehouse: Warehouse, lease: str) -> None:
    """Return claims older than the lease to the queue."""
    stale = state.requeue_stale(request_state(warehouse), F.current_timestamp(), lease)
    append_log(warehouse, stage(stale, "requeued"))


def answer(warehouse: Warehouse, claimed: DataFrame, base_url: str, fetch: Callable[[str, Attempt], Reply],
           policy: RetryPolicy, partitions: int | None, threads: int, portions: str | None = None) -> RunCounters:
    """Log a staged claim, look it up and record the outcomes; ``portions`` is a folder for this claim alone, see ``enrich``."""
    _, taken = counted(claimed, lambda rows: append_log(warehouse, rows), claimed=F.count(F.lit(1)))
    found = enrich(claimed, base_url, fetch, policy, partitions, threads, portions)
    outcomes, seen = counted(found, lambda rows: stage(rows, "outcomes"), fetched=F.count(F.lit(1)), failed_fetch=F.count_if(~F.col("ok")))
    return RunCounters(**taken, **seen) + store_outcomes(warehouse, claimed, outcomes)


def backfill(
    warehouse: Warehouse,
    base_url: str,
    fetch: Callable[[str, Attempt], Reply],
    policy: RetryPolicy = RetryPolicy(),
    batch_size: int | None = None,
    partitions: int | None = None,
    threads: int = 10,
    lease: str = "1 minute",
    portions: str | None = None,
) -> DataFrame:
    """Requeue stale claims, claim pending requests, look them up and record the outcomes.

    Without a batch size one pass drains everything that is pending. Failed
    requests are final. Returns the run's statistics. The run reads the newest snapshot and the log behind it, and writes a new
    snapshot once the log has grown by many files, so that its cost does not grow with the runs before it.
    """
    requeue(warehouse, lease)
    pending = request_state(warehouse).where("status = 'pending'")
    queue, waiting = counted(pending, lambda rows: stage(rows, "queue"), queued=F.count(F.lit(1)))
    claimed = stage(state.claim_batch(queue, F.current_timestamp(), batch_size), "claimed")
    for log in (_request_log(warehouse), _response_log(warehouse)):
        log.compact_if_due()
    counters = RunCounters(**waiting) + answer(warehouse, claimed, base_url, fetch, policy, partitions, threads, portions)
    return counters.table(warehouse.spark)


def drain(
    warehouse: Warehouse,
    base_url: str,
    fetch: Callable[[str, Attempt], Reply],
    policy: RetryPolicy = RetryPolicy(),
    batch_size: int = 100_000,
    partitions: int | None = None,
    threads: int = 10,
    lease: str = "1 minute",
) -> DataFrame:
    """Answer everything that is pending in portions, each recorded before the next begins.

    The log is read and the queue ordered once; portions are ranges of the numbered queue, so a run that breaks off repeats
    at most one portion. Returns the statistics of the run.
    """
    requeue(warehouse, lease)
    pending = request_state(warehouse).where("status = 'pending'")
    queue, waiting = counted(dense_id(pending, state.KEY, "turn", unique_order=True), lambda rows: stage(rows, "queue"), queued=F.count(F.lit(1)))
    counters = RunCounters(**waiting)
    for start in range(0, counters.queued, batch_size):
        portion = queue.where(F.col("turn").between(start + 1, start + batch_size)).drop("turn")
        claimed = stage(state.claim_batch(portion, F.current_timestamp()), "claimed")
        counters += answer(warehouse, claimed, base_url, fetch, policy, partitions, threads)
    return counters.table(warehouse.spark)


def compact_responses(warehouse: Warehouse) -> DataFrame:
    """Publish one response per key as its own table; the log stays as it is."""
    newest = _response_log(warehouse).state()
    return warehouse.publish(
        "weather_response_raw", newest.select(*contracts.WEATHER_RAW.names), contracts.WEATHER_RAW
    )


def add_flights(warehouse: Warehouse, flights_csv: str, airports: DataFrame | None = None, quarantine: bool = False) -> DataFrame:
    """Add another flights source to the published flights and open the requests that it brings. Returns the new requests.

    The files of earlier flights stay as they are. A source is known by its path: one that was added before is not added again, so
    a call that broke off is repeated as it was. ``airports`` are the published ones by default.
    """
    spark = warehouse.spark
    before = warehouse.version("flight_data")
    flights = clean_flights(read_flights(spark, flights_csv))
    if flights_csv not in before.sources:
        _sound(warehouse, "flight_data", malformed_lines(spark, flights_csv, FLIGHT_COLUMNS), quarantine)
        warehouse.extend("flight_data", flights, contracts.FLIGHTS, sources=(*before.sources, flights_csv))
    wanted = enrichment_requests(flights, airports if airports is not None else warehouse.table("airport_data"))
    known = warehouse.table("weather_req_table").select(*state.KEY)
    fresh = stage(wanted.join(known, list(state.KEY), "left_anti").select(*wanted.columns), "fresh-requests")
    if not fresh.isEmpty():
        warehouse.extend("weather_req_table", fresh, contracts.WEATHER_REQUESTS)
    opened = request_state(warehouse, wanted).select(*state.KEY)
    append_log(warehouse, state.open_log(wanted).join(opened, list(state.KEY), "left_anti"))
    return fresh


def _newest_fetch(warehouse: Warehouse):
    return responses(warehouse).agg(F.max("fetched_at").alias("at")).first().at


def build_model_dataset(warehouse: Warehouse, order_by: tuple[str, ...] = NATURAL_ORDER) -> DataFrame:
    """Publish the wide dataset, numbered by flight and partitioned by year and month."""
    flights, read_until = warehouse.version("flight_data"), _newest_fetch(warehouse)
    dataset = model_dataset(warehouse.files("flight_data", flights).select(*flights.schema.names), responses(warehouse), order_by)
    return warehouse.publish(
        "model_dataset", dataset, contracts.MODEL_DATASET, partition_by=DATASET_PARTS, mark="id",
        sources=tuple(flights.parts), read_until=read_until,
    )


def update_model_dataset(warehouse: Warehouse, order_by: tuple[str, ...] = NATURAL_ORDER, overlap: str = "10 minutes") -> DataFrame:
    """Rebuild the months of the dataset that new flights or new weather reach; the files of other months stay.

    New flights are those in parts of ``flight_data`` that the dataset was not built from; they are numbered behind the highest id
    ever given. Rows that were there keep their ids and take the newest weather. New weather is what was fetched after the
    newest response that the dataset saw, less ``overlap`` for responses that were being stored then; a month
    rebuilt without need comes out alike. Flights that were published anew as a whole call for ``build_model_dataset``, which is done.
    Nothing new publishes nothing.
    """
    before, flights = warehouse.version("model_dataset"), warehouse.version("flight_data")
    if not set(before.sources) <= set(flights.parts):
        return build_model_dataset(warehouse, order_by)
    read_until = _newest_fetch(warehouse)
    arrived = responses(warehouse)
    if before.read_until is not None:
        arrived = arrived.where(F.col("fetched_at") > F.lit(before.read_until) - F.expr(f"INTERVAL {overlap}"))
    days = stage(arrived.select("date", "code").distinct(), "changed-days")
    added = [folder for folder in flights.parts if folder not in before.sources]
    new = warehouse.files("flight_data", flights, added).select(*flights.schema.names)

    whole = warehouse.files("model_dataset", before).select(
        F.col("flight_date").alias("date"), F.explode(F.array("origin", "dest")).alias("code"), *DATASET_PARTS)
    reached = whole.join(days, ["date", "code"], "left_semi").select(*DATASET_PARTS)
    # One row a month.
    months = {tuple(row) for row in reached.unionByName(new.select(*DATASET_PARTS)).distinct().collect()}
    if not months:
        return warehouse.table("model_dataset")
    held = {"/".join(f"{name}={NO_VALUE if value is None else value}" for name, value in zip(DATASET_PARTS, month)) for month in months}
    replaced = [folder for folder in before.parts if partition_of(folder) in held]

    own_names = {name: source for source, name in DATASET_NAMES.items()}
    old = warehouse.files("model_dataset", before, replaced).withColumnsRenamed(own_names).select("id", *flights.schema.names)
    numbered = old.unionByName(dense_id(new, order_by, after=before.high or 0)) if added else old
    rows = stage(numbered, "changed-flights")
    keys = rows.select("date", F.explode(F.array("origin", "dest")).alias("code")).distinct()
    dataset = dataset_rows(rows, weather_table(responses(warehouse, keys)))
    return warehouse.extend(
        "model_dataset", dataset.select(*before.schema.names), contracts.MODEL_DATASET, DATASET_PARTS, replaced, mark="id",
        sources=tuple(flights.parts), read_until=read_until,
    )


def audit(warehouse: Warehouse) -> DataFrame:
    """Row counts of the published tables, as counted when they were published."""
    return warehouse.current().select(F.col("name").alias("table_name"), F.col("rows").alias("row_count"))

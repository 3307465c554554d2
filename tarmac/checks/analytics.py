"""Queries of the dataset, statistics, splits, training and scoring."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.checks import views
from tarmac.checks.registry import query
from tarmac.checks.views import with_views
from tarmac.fields import MODEL_FEATURES, NUMERIC_FEATURES, WEATHER_FIELDS
from tarmac.functions import clock, geo
from tarmac.functions.requests import miles_text, percent_text, request_errors, risk_label, significant_delay
from tarmac.functions.requests import unknown_fields
from tarmac.operators import contracts, features, metrics, profile, split
from tarmac.operators.ids import dense_id
from tarmac.operators.matching import match_schedule
from tarmac.operators.matching import schedule_documents as read_documents
from tarmac.operators.matching import schedule_rows as read_rows
from tarmac.operators.matching import schedule_status as read_status
from tarmac.plans import bagging, scoring, training
from tarmac.sources.documents import stored_documents
from tarmac.sources.scratch import scratch_path, stage

DATASET_COLUMNS = contracts.MODEL_DATASET.names
COMPLETE = " AND ".join(f"{name} IS NOT NULL" for name in DATASET_COLUMNS)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset before numbering."""
    return features.dataset_rows(views.flights(spark, sf_dir), features.weather_table(views.responses(spark, sf_dir)))


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.model_dataset(
        views.flights(spark, sf_dir), views.responses(spark, sf_dir), ("flight_number",), unique_order=True
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights with a known delay, their unique number and label."""
    flights = views.flights(spark, sf_dir).where(F.col("total_delay").isNotNull())
    return flights.select(
        F.col("flight_number").cast("bigint").alias("id"),
        significant_delay(F.col("total_delay")).alias("significant"),
    )


LABELLED = """
    SELECT CAST(flight_number AS BIGINT) AS id, CAST(total_delay >= 25 AS INTEGER) AS significant
    FROM flights WHERE total_delay IS NOT NULL"""


@query(with_views(f"SELECT {', '.join(DATASET_COLUMNS)} FROM dataset", "dataset"))
def model_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir)


@query(with_views(f"""
    SELECT count(*) AS n, count(DISTINCT id) AS ids, min(id) AS first_id, max(id) AS last_id FROM dataset""", "dataset"))
def dense_id_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = dense_id(views.flights(spark, sf_dir))
    return numbered.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"),
        F.min("id").alias("first_id"), F.max("id").alias("last_id"),
    )


@query(with_views(f"""
    SELECT CAST(flight_number AS BIGINT) AS flight, row_number() OVER (ORDER BY date, origin, flight_number) AS id
    FROM flights""", "flights"))
def ordered_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = dense_id(views.flights(spark, sf_dir), ("date", "origin", "flight_number"))
    return numbered.select(F.col("flight_number").cast("bigint").alias("flight"), "id")


@query(with_views("SELECT * FROM weather", "weather"))
def weather_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.weather_values(features.newest_responses(views.responses(spark, sf_dir)))


@query(with_views("SELECT code, date, " + ", ".join(WEATHER_FIELDS) + " FROM weather", "weather"))
def stored_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values by path from documents that were parsed when they were stored."""
    stored = stored_documents(features.newest_responses(views.responses(spark, sf_dir)), label="stored-weather")
    return features.weather_values(stored).select("code", "date", *WEATHER_FIELDS)


@query(with_views("SELECT code, date, " + ", ".join(WEATHER_FIELDS) + " FROM weather", "weather"))
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = weather_values(spark, sf_dir)
    daily = F.struct(*[F.array(field).alias(field) for field in WEATHER_FIELDS])
    stored = parsed.select("code", "date", F.to_json(F.struct(daily.alias("daily"))).alias("payload"))
    return features.weather_values(stored).select("code", "date", *WEATHER_FIELDS)


@query(with_views(f"""
    SELECT significant, CASE significant WHEN 1 THEN 'significant' ELSE 'not_significant' END AS class_name,
        count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share
    FROM (SELECT CAST(delay >= 25 AS INTEGER) AS significant FROM dataset WHERE {COMPLETE})
    GROUP BY significant""", "dataset"))
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = features.with_label(features.complete_rows(_rows(spark, sf_dir)))
    return profile.class_distribution(labelled).withColumn("share", F.round("share", 9))


@query(with_views(" UNION ALL ".join(
    f"""SELECT '{name}' AS feature,
        round(avg(CASE WHEN delay < 25 THEN CAST({name} IS NULL AS INTEGER) END), 9) AS not_significant,
        round(avg(CASE WHEN delay >= 25 THEN CAST({name} IS NULL AS INTEGER) END), 9) AS significant FROM known"""
    for name in MODEL_FEATURES), "dataset", known="SELECT * FROM dataset WHERE delay IS NOT NULL"))
def missing_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = profile.missing_by_target(features.known_target(_rows(spark, sf_dir)))
    return table.select("feature", *[F.round(name, 9).alias(name) for name in ("not_significant", "significant")])


@query(with_views("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS feature, CASE WHEN min({name}) < max({name}) THEN round(covar_pop({name}, y) / (stddev_pop({name}) * stddev_pop(y)), 9) END AS correlation FROM complete"
    for name in NUMERIC_FEATURES) + ") WHERE correlation IS NOT NULL AND NOT isnan(correlation)", "dataset",
    complete=f"SELECT *, CAST(delay >= 25 AS INTEGER) AS y FROM dataset WHERE {COMPLETE}"))
def target_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = features.with_label(features.complete_rows(_rows(spark, sf_dir)))
    return profile.target_correlation(labelled).select("feature", F.round("correlation", 9).alias("correlation"))


@query(with_views(f"""
    SELECT id, {', '.join(MODEL_FEATURES)}, CAST(delay >= 25 AS INTEGER) AS significant
    FROM dataset WHERE id <= (SELECT count(*) // 2 FROM flights) AND {COMPLETE}""", "dataset", "flights"))
def capped_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = _dataset(spark, sf_dir)
    return features.training_rows(dataset, cap=dataset.count() // 2)


@query(with_views(f"""
    SELECT id, place <= round_even(0.2e0 * n, 0) AS is_test, significant FROM (
        SELECT id, significant, row_number() OVER (PARTITION BY significant ORDER BY md5('1:' || CAST(id AS VARCHAR))) AS place,
            count(*) OVER (PARTITION BY significant) AS n FROM labelled)""", "flights", labelled=LABELLED))
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.train_test(_labelled(spark, sf_dir)).select("id", "is_test", "significant")


@query(with_views(f"""
    SELECT id, significant, CAST(CASE WHEN place <= round_even(n / 3e0, 0) THEN 0
        WHEN place <= round_even(n / 3e0 * 2, 0) THEN 1 ELSE 2 END AS INTEGER) AS fold FROM (
        SELECT id, significant, row_number() OVER (PARTITION BY significant ORDER BY md5('7:' || CAST(id AS VARCHAR))) AS place,
            count(*) OVER (PARTITION BY significant) AS n FROM labelled)""", "flights", labelled=LABELLED))
def fold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.folds(_labelled(spark, sf_dir), 3, seed=7).select("id", "significant", "fold")


@query(with_views("""
    SELECT significant, count(*) AS n,
        round((SELECT count(*) FROM labelled) / (2e0 * count(*)), 9) AS weight
    FROM labelled GROUP BY significant""", "flights", labelled=LABELLED))
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = profile.class_weights(_labelled(spark, sf_dir))
    return table.select("significant", "n", F.round("weight", 9).alias("weight"))


def _uniform_sql(salt: str) -> str:
    return f"(CAST(('0x' || substr(md5('{salt}:' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296e0)"


SPLIT_SQL = """
    SELECT id, significant, place <= round_even(0.2e0 * n, 0) AS is_test FROM (
        SELECT id, significant, row_number() OVER (PARTITION BY significant ORDER BY md5('1:' || CAST(id AS VARCHAR))) AS place,
            count(*) OVER (PARTITION BY significant) AS n FROM labelled)"""


@query(with_views(f"""
    SELECT strategy, round(avg(CAST(guess = significant AS INTEGER)), 9) AS accuracy FROM (
        SELECT 'most_frequent' AS strategy, significant, (SELECT CAST(avg(significant) > 0.5 AS INTEGER) FROM parted WHERE NOT is_test) AS guess FROM parted WHERE is_test
        UNION ALL SELECT 'stratified', significant, CAST({_uniform_sql('stratified0')} < (SELECT avg(significant) FROM parted WHERE NOT is_test) AS INTEGER) FROM parted WHERE is_test
        UNION ALL SELECT 'uniform', significant, CAST({_uniform_sql('uniform0')} < 0.5 AS INTEGER) FROM parted WHERE is_test)
    GROUP BY strategy""", "flights", labelled=LABELLED, parted=SPLIT_SQL))
def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = split.train_test(_labelled(spark, sf_dir))
    table = training.baseline_scores(parted.where("NOT is_test"), parted.where("is_test"))
    return table.select("strategy", F.round("accuracy", 9).alias("accuracy"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a repeatable score in 1/1000 steps, so that many scores tie."""
    draw = training.uniform_draw("id", "score")
    score = F.floor((draw * 0.8 + F.col("significant") * 0.2) * 1000) / 1000
    return _labelled(spark, sf_dir).withColumn("probability", score).withColumn(
        "prediction", (F.col("probability") >= 0.5).cast("int")
    )


SCORED = f"""
    SELECT *, CAST(probability >= 0.5 AS INTEGER) AS prediction FROM (
        SELECT id, significant, floor(({_uniform_sql('score')} * 0.8e0 + significant * 0.2e0) * 1000) / 1000 AS probability FROM labelled)"""
CONFUSION = """
    SELECT count(*) AS n, count(*) FILTER (WHERE significant = 1 AND prediction = 1) AS tp,
        count(*) FILTER (WHERE significant = 0 AND prediction = 1) AS fp,
        count(*) FILTER (WHERE significant = 1 AND prediction = 0) AS fn,
        count(*) FILTER (WHERE significant = 0 AND prediction = 0) AS tn FROM scored"""


@query(with_views("""
    SELECT n, tp, fp, fn, tn, round((tp + tn) / CAST(n AS DOUBLE), 9) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision,
        round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 9) AS f1 FROM counts""",
    "flights", labelled=LABELLED, scored=SCORED, counts=CONFUSION))
def score_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.score_metrics(_scored(spark, sf_dir))
    ratios = ("accuracy", "precision", "recall", "f1")
    return table.withColumns({name: F.round(name, 9) for name in ratios})


@query(with_views("SELECT significant, prediction, count(*) AS n FROM scored GROUP BY significant, prediction",
                  "flights", labelled=LABELLED, scored=SCORED))
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_scored(spark, sf_dir))


AUC_SQL = with_views("""
    SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
        round(sum(pos * (below + neg / 2e0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 9) AS auc
    FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT probability, count(*) FILTER (WHERE significant = 1) AS pos, count(*) FILTER (WHERE significant = 0) AS neg
            FROM scored GROUP BY probability))""", "flights", labelled=LABELLED, scored=SCORED)


@query(AUC_SQL)
def score_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(_scored(spark, sf_dir)).withColumn("auc", F.round("auc", 9))


@query(with_views("""
    SELECT CAST(f.flight_number AS BIGINT) AS flight, CAST(round_even(3958.7613e0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 0) AS INTEGER) AS miles
    FROM (SELECT f.flight_number, pow(sin(radians(d.lat - o.lat) / 2), 2)
            + cos(radians(o.lat)) * cos(radians(d.lat)) * pow(sin(radians(d.long - o.long) / 2), 2) AS a
        FROM flights f JOIN airports o ON o.code = f.origin JOIN airports d ON d.code = f.dest) f""", "flights", "airports"))
def distance_miles(spark: SparkSession, sf_dir: str) -> DataFrame:
    airports = views.airports(spark, sf_dir)
    ends = {
        end: airports.select(F.col("code").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("long").alias(f"{end}_long"))
        for end in ("origin", "dest")
    }
    flights = views.flights(spark, sf_dir).join(ends["origin"], "origin").join(ends["dest"], "dest")
    miles = geo.distance_miles(*map(F.col, ("origin_lat", "origin_long", "dest_lat", "dest_long")))
    return flights.select(F.col("flight_number").cast("bigint").alias("flight"), miles.alias("miles"))


@query("""
    SELECT c_custkey, CAST(CASE WHEN lat IS NULL THEN 500 WHEN isnan(lat) OR lat < -90 OR lat > 90 OR long < -180 OR long > 180 THEN 400 ELSE 200 END AS INTEGER) AS status
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN CAST('nan' AS DOUBLE) ELSE c_custkey % 200 - 100e0 END AS lat,
        c_custkey % 380 - 190e0 AS long FROM customer)""")
def coord_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = F.col("c_custkey")
    lat = F.when(cust % 13 == 0, F.lit(None).cast("double")).when(cust % 17 == 0, F.lit(float("nan"))).otherwise(cust % 200 - 100.0)
    status = geo.coordinate_status(lat, cust % 380 - 190.0, F.lit(0.0), F.lit(0.0))
    return views.read(spark, sf_dir, "customer").select("c_custkey", status.alias("status"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
        CAST(day(l_shipdate) AS INTEGER) AS day_of_month, CAST(isodow(l_shipdate) AS INTEGER) AS day_of_week FROM lineitem""")
def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = clock.calendar_parts(F.col("l_shipdate").cast("date"))
    return views.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", *[value.alias(name) for name, value in parts.items()]
    )


@query("""
    SELECT event_id, CAST(((arr - dep) % 1440 + 1440) % 1440 AS INTEGER) AS elapsed,
        CAST(dep // 60 * 100 + dep % 60 AS BIGINT) AS dep_hhmm, CAST(arr // 60 * 100 + arr % 60 AS BIGINT) AS arr_hhmm
    FROM (SELECT event_id, CAST(event_id * 37 % 1440 AS INTEGER) AS dep, CAST(user_id * 101 % 1440 AS INTEGER) AS arr FROM events)""")
def elapsed_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dep, arr = (F.col("event_id") * 37 % 1440).cast("int"), (F.col("user_id") * 101 % 1440).cast("int")
    return views.read(spark, sf_dir, "events").select(
        "event_id", clock.elapsed_minutes(dep, arr).alias("elapsed"),
        clock.hhmm(dep).alias("dep_hhmm"), clock.hhmm(arr).alias("arr_hhmm"),
    )


# Texts in and beyond the supported formats; {h} and {m} are an hour and a minute.
CLOCK_TEXTS = (
    ("lpad(h, 2, '0') || ':' || lpad(m, 2, '0')", "valid"),
    ("' ' || h || ':' || m || ':09 '", "valid"),
    ("lpad(h, 2, '0') || lpad(m, 2, '0')", "valid"),
    ("'2026-08-20T' || lpad(h, 2, '0') || ':' || lpad(m, 2, '0') || ':00.5+02:00'", "valid"),
    ("'2026-08-20 ' || lpad(h, 2, '0') || ':' || lpad(m, 2, '0') || 'Z'", "valid"),
    ("'24:' || lpad(m, 2, '0')", "unknown"),
    ("'2026-02-30T' || lpad(h, 2, '0') || ':' || lpad(m, 2, '0')", "unknown"),
    ("h || 'h' || m", "unknown"),
)


@query(f"""
    SELECT event_id, CASE WHEN valid THEN lpad(h, 2, '0') || ':' || lpad(m, 2, '0') ELSE trim(given) END AS normalised,
        CASE WHEN valid THEN CAST(h AS INTEGER) * 60 + CAST(m AS INTEGER) END AS minutes,
        coalesce(valid AND least(abs(CAST(h AS INTEGER) * 60 + CAST(m AS INTEGER) - 20), 1440 - abs(CAST(h AS INTEGER) * 60 + CAST(m AS INTEGER) - 20)) <= 30, FALSE) AS near_midnight
    FROM (SELECT event_id, h, m, event_id % 8 < 5 AS valid,
            CASE event_id % 8 {' '.join(f"WHEN {i} THEN {text}" for i, (text, _) in enumerate(CLOCK_TEXTS))} END AS given
        FROM (SELECT event_id, CAST(event_id * 7 % 24 AS VARCHAR) AS h, CAST(user_id * 11 % 60 AS VARCHAR) AS m FROM events))""")
def clock_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = " ".join(f"WHEN {i} THEN {text}" for i, (text, _) in enumerate(CLOCK_TEXTS))
    texts = views.read(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") * 7 % 24).cast("string").alias("h"), (F.col("user_id") * 11 % 60).cast("string").alias("m"),
    ).select("event_id", F.expr(f"CASE event_id % 8 {cases} END").alias("given"))
    given = F.col("given")
    return texts.select(
        "event_id", clock.normalize_clock(given).alias("normalised"), clock.clock_minutes(given).alias("minutes"),
        clock.clocks_match(given, F.lit("00:20")).alias("near_midnight"),
    )


SCHEDULE_ROWS_SQL = with_views("""
    SELECT date, dep_code, dest_code, page, item, dep_minutes, arr_minutes FROM schedule""", "schedule")


@query(SCHEDULE_ROWS_SQL)
def schedule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offered(views.schedule_responses(spark, sf_dir))


@query(SCHEDULE_ROWS_SQL)
def stored_schedule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offered(stored_documents(views.schedule_responses(spark, sf_dir), label="stored-pages"))


def _offered(responses: DataFrame) -> DataFrame:
    rows = read_rows(read_documents(responses))
    return rows.select(
        "date", "dep_code", "dest_code", "page", "item", F.col("offered_minutes").alias("dep_minutes"),
        clock.clock_minutes(F.col("arr_clock")).alias("arr_minutes"),
    )


@query(with_views("""
    SELECT date, dep_code, CASE WHEN day = 5 AND dep_number = 1 THEN 'malformed'
            WHEN (day = 3 AND dep_number = 0) OR (day = 7 AND dep_number = 2) THEN 'absent' END AS schedule_fault,
        CAST(CASE WHEN day = 3 AND dep_number = 0 THEN 503 END AS INTEGER) AS error_code
    FROM schedule_events GROUP BY ALL""", "schedule_events"))
def schedule_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_status(read_documents(views.schedule_responses(spark, sf_dir)))


@query(with_views("SELECT req_id, page, item, offered_minutes FROM matches WHERE valid", "matches"))
def schedule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = scoring.checked_requests(scoring.normalise_requests(views.scoring_requests(spark, sf_dir)))
    rows = read_rows(read_documents(views.schedule_responses(spark, sf_dir)))
    valid = asked.where(F.size("request_errors") == 0)
    return match_schedule(valid, rows).select(
        "req_id", F.col("matched.page").alias("page"), F.col("matched.item").alias("item"),
        clock.clock_minutes(F.col("matched.dep_clock")).alias("offered_minutes"),
    )


STRICT_SQL = "CASE WHEN k IN (31, 37) THEN '{end} weather daily payload was invalid.' " + " ".join(
    f"WHEN {when} THEN '{{end}} weather field ''{field}'' {what}'" for field, when, what in (
        ("rain_sum", "k = 7", "was missing or invalid."),
        ("showers_sum", "k % 10 = 0", "value was invalid."),
        ("snowfall_sum", "k = 13", "was missing or invalid."),
        ("cloud_cover_mean", "k = 29", "value was invalid."),
        ("pressure_msl_mean", "k = 23", "value was invalid."),
    )) + " END"


STRICT_ROWS_SQL = with_views(f"""
    SELECT code, date, status_code, status_code <> 200 AS absent, fault,
        CASE WHEN fault IS NULL THEN value END AS weather_code, CASE WHEN fault IS NULL THEN value + k * 13 END AS pressure_msl_mean
    FROM (SELECT *, {STRICT_SQL} AS fault, CAST(CASE WHEN k = 53 THEN 503 ELSE 200 END AS INTEGER) AS status_code FROM newest_events)""",
    "newest_events")


@query(STRICT_ROWS_SQL)
def strict_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strict_rows(scoring.strict_weather(features.newest_responses(views.responses(spark, sf_dir))))


@query(STRICT_ROWS_SQL)
def stored_strict_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stored_documents(features.newest_responses(views.responses(spark, sf_dir)), label="stored-weather")
    return _strict_rows(scoring.strict_weather(stored))


def _strict_rows(checked: DataFrame) -> DataFrame:
    sound = F.col("fault").isNull()
    return checked.select(
        "code", "date", "status_code", "absent", "fault",
        *[F.when(sound, F.col(name)).alias(name) for name in ("weather_code", "pressure_msl_mean")],
    )


@query("""
    SELECT o_orderkey AS req_id, 
        '[' || concat_ws(', ', CASE WHEN o_orderkey % 53 = 0 THEN 'date' END, CASE WHEN o_orderkey % 61 = 0 THEN 'scheduledDepartureTime' END,
        CASE WHEN o_orderkey % 59 = 0 AND o_orderkey % 43 <> 0 THEN 'destIataCode' END) || ']' AS errors,
        CASE WHEN o_orderkey % 3 = 0 THEN '[car]' ELSE '[]' END AS unknown_fields
    FROM orders""")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = scoring.normalise_requests(views.scoring_requests(spark, sf_dir))
    names = ("date", "scheduledDepartureTime", "depIataCode", "destIataCode")
    document = F.to_json(F.struct(*names, F.when(F.col("req_id") % 3 == 0, "no").alias("car")))

    def listed(names_found):
        return F.concat(F.lit("["), F.array_join(names_found, ", "), F.lit("]"))

    return asked.select(
        "req_id", listed(request_errors(*map(F.col, names))).alias("errors"),
        listed(unknown_fields(document)).alias("unknown_fields"),
    )


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.request_outcomes(
        scoring.normalise_requests(views.scoring_requests(spark, sf_dir)),
        views.requests(spark, sf_dir),
        views.schedule_responses(spark, sf_dir),
        views.airports(spark, sf_dir),
        features.newest_responses(views.responses(spark, sf_dir)),
    )


LADDER = {
    "strict": f"""SELECT code, date, k, value, {STRICT_SQL} AS fault FROM newest_events""",
    "placed": """
        SELECT m.*, o.k AS o_k, d.k AS d_k, o.fault AS o_fault, d.fault AS d_fault, o.value AS o_value, d.value AS d_value,
            o.code IS NOT NULL AS o_found, d.code IS NOT NULL AS d_found,
            EXISTS (SELECT 1 FROM requests r WHERE r.code = m.dep_code) AS known,
            EXISTS (SELECT 1 FROM schedule_events s WHERE s.date = m.date AND s.dep_code = m.dep_code) AS replied
        FROM matches m
        LEFT JOIN strict o ON o.date = m.date AND o.code = m.dep_code
        LEFT JOIN strict d ON d.date = m.date AND d.code = m.dest_code""",
    "outcomes": """
        SELECT *, CASE WHEN NOT valid THEN 'request' WHEN NOT known THEN 'departure_airport'
            WHEN NOT replied OR (day(date) = 3 AND dep_code = 'N00') OR (day(date) = 7 AND dep_code = 'N02') THEN 'schedule_absent'
            WHEN day(date) = 5 AND dep_code = 'N01' THEN 'schedule_malformed'
            WHEN page IS NULL THEN 'match' WHEN arr_minutes IS NULL THEN 'times' WHEN dest_code = 'ZZY' THEN 'airports'
            WHEN NOT dep_short OR NOT arr_short THEN 'clocks'
            WHEN NOT o_found OR o_k = 53 THEN 'origin_weather' WHEN NOT d_found OR d_k = 53 THEN 'dest_weather'
            WHEN o_fault IS NOT NULL THEN 'origin_weather' WHEN d_fault IS NOT NULL THEN 'dest_weather'
            ELSE 'complete' END AS stage FROM placed""",
    "coded": """
        SELECT *, CAST(CASE stage WHEN 'request' THEN 422 WHEN 'departure_airport' THEN 404
            WHEN 'schedule_absent' THEN CASE WHEN day(date) = 3 AND dep_code = 'N00' AND replied THEN 503 ELSE 502 END
            WHEN 'schedule_malformed' THEN 502 WHEN 'match' THEN 404 WHEN 'times' THEN 502 WHEN 'airports' THEN 404
            WHEN 'clocks' THEN 400 WHEN 'origin_weather' THEN CASE WHEN o_k = 53 THEN 503 ELSE 502 END
            WHEN 'dest_weather' THEN CASE WHEN d_k = 53 THEN 503 ELSE 502 END ELSE 200 END AS INTEGER) AS status_code,
            CASE stage WHEN 'origin_weather' THEN coalesce(CASE WHEN o_found AND o_k <> 53 AND (d_found AND d_k <> 53) THEN replace(o_fault, '{end}', 'origin') END, """
    f"'{scoring.MESSAGES['origin_weather']}') WHEN 'dest_weather' THEN coalesce(CASE WHEN d_found AND d_k <> 53 THEN replace(d_fault, '{{end}}', 'dest') END, "
    f"'{scoring.MESSAGES['dest_weather']}') " + " ".join(
        f"WHEN '{stage_name}' THEN '{text}'" for stage_name, text in scoring.MESSAGES.items()
        if stage_name not in ("origin_weather", "dest_weather")
    ) + " END AS message FROM outcomes",
}
LADDER_VIEWS = ("requests", "matches", "newest_events", "schedule_events")


@query(with_views("""
    SELECT req_id, stage, status_code, message, CASE WHEN status_code = 200 THEN CAST(offered_minutes // 60 * 100 + offered_minutes % 60 AS BIGINT) END AS pred_dep_time,
        CASE WHEN status_code = 200 THEN CAST(arr_minutes // 60 * 100 + arr_minutes % 60 AS BIGINT) END AS pred_arr_time,
        CASE WHEN status_code = 200 THEN CAST(year(c.date) AS INTEGER) END AS year, CASE WHEN status_code = 200 THEN CAST(month(c.date) AS INTEGER) END AS month,
        CASE WHEN status_code = 200 THEN CAST(day(c.date) AS INTEGER) END AS day_of_month,
        CASE WHEN status_code = 200 THEN o.name END AS origin_city_name, CASE WHEN status_code = 200 THEN o.lat END AS origin_lat,
        CASE WHEN status_code = 200 THEN o.long END AS origin_long, CASE WHEN status_code = 200 THEN d.name END AS dest_city_name,
        CASE WHEN status_code = 200 THEN d.lat END AS dest_lat, CASE WHEN status_code = 200 THEN d.long END AS dest_long,
        CASE stage WHEN 'match' THEN '{"origin":"' || dep_code || '","dest":"' || dest_code || '","minutes":' || dep_minutes || '}' END AS detail,
        CASE WHEN status_code = 200 THEN o_value END AS origin_weather_code, CASE WHEN status_code = 200 THEN d_value + d_k * 13 END AS dest_pressure_msl_mean
    FROM coded c LEFT JOIN airports o ON o.code = c.dep_code LEFT JOIN airports d ON d.code = c.dest_code""",
    *LADDER_VIEWS, "airports", **LADDER))
def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    complete = F.col("status_code") == 200
    return _outcomes(spark, sf_dir).select(
        "req_id", "stage", "status_code", "message", F.when(F.col("stage") == "match", F.col("detail")).alias("detail"),
        *[F.when(complete, F.col(name)).alias(name) for name in (
            "pred_dep_time", "pred_arr_time", "year", "month", "day_of_month", "origin_city_name", "origin_lat", "origin_long",
            "dest_city_name", "dest_lat", "dest_long", "origin_weather_code", "dest_pressure_msl_mean")],
    )


def _sql_clock(minutes: str) -> str:
    return f"lpad(CAST({minutes} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({minutes} % 60 AS VARCHAR), 2, '0')"


# Complete requests with both airports, the matched flight and every model feature.
LADDER["complete"] = f"""
    SELECT c.*, o.name AS origin_city_name, o.lat AS origin_lat, o.long AS origin_long, d.name AS dest_city_name, d.lat AS dest_lat, d.long AS dest_long,
        {_sql_clock("offered_minutes")} AS dep_clock, {_sql_clock("arr_minutes")} AS arr_clock,
        c.date AS flight_date, c.dep_code AS origin, c.dest_code AS dest, CAST(year(c.date) AS INTEGER) AS year, CAST(month(c.date) AS INTEGER) AS month,
        CAST(day(c.date) AS INTEGER) AS day_of_month, CAST(isodow(c.date) AS INTEGER) AS day_of_week,
        CAST(offered_minutes // 60 * 100 + offered_minutes % 60 AS BIGINT) AS pred_dep_time, CAST(arr_minutes // 60 * 100 + arr_minutes % 60 AS BIGINT) AS pred_arr_time,
        (arr_minutes - offered_minutes + 1440) % 1440 AS pred_elapsed_time,
        CAST(round_even(3958.7613e0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 0) AS INTEGER) AS fl_distance,
        {", ".join(f"{end}_value + {end}_k * {index} AS {name}_{field}" for end, name in (("o", "origin"), ("d", "dest")) for index, field in enumerate(WEATHER_FIELDS))}
    FROM coded c JOIN airports o ON o.code = c.dep_code JOIN airports d ON d.code = c.dest_code,
        LATERAL (SELECT pow(sin(radians(d.lat - o.lat) / 2), 2) + cos(radians(o.lat)) * cos(radians(d.lat)) * pow(sin(radians(d.long - o.long) / 2), 2) AS a)
    WHERE status_code = 200"""
ROUTE_TEXTS = ("origin_city_name", "origin_lat", "origin_long", "dest_city_name", "dest_lat", "dest_long", "dep_clock", "arr_clock")


@query(with_views(f"SELECT req_id, {', '.join((*ROUTE_TEXTS, *MODEL_FEATURES))} FROM complete", *LADDER_VIEWS, "airports", **LADDER))
def request_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of every complete request, with the names, places and clocks beside them."""
    return _outcomes(spark, sf_dir).where("status_code = 200").select("req_id", *ROUTE_TEXTS, *MODEL_FEATURES)


@query(with_views("SELECT req_id, stage, status_code AS code, message AS description FROM coded WHERE status_code <> 200",
                  *LADDER_VIEWS, **LADDER))
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.quarantine(_outcomes(spark, sf_dir)).drop("detail")


@query(with_views("""
    SELECT m.req_id, m.date AS flight_date, m.dep_code AS origin, m.dest_code AS dest, o.name AS origin_city_name, d.name AS dest_city_name,
        CAST(isodow(m.date) AS INTEGER) AS day_of_week, CASE WHEN dep_short THEN CAST(offered_minutes // 60 * 100 + offered_minutes % 60 AS BIGINT) END AS pred_dep_time,
        CASE WHEN dep_short AND arr_short THEN (arr_minutes - offered_minutes + 1440) % 1440 END AS pred_elapsed_time
    FROM matches m JOIN airports o ON o.code = m.dep_code JOIN airports d ON d.code = m.dest_code
    WHERE m.valid AND m.page IS NOT NULL""", "matches", "airports"))
def flight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = scoring.checked_requests(scoring.normalise_requests(views.scoring_requests(spark, sf_dir)))
    rows = read_rows(read_documents(views.schedule_responses(spark, sf_dir)))
    built = scoring.flight_rows(asked, rows, views.airports(spark, sf_dir))
    return built.where("origin_found AND dest_found AND matched IS NOT NULL").select(
        "req_id", "flight_date", "origin", "dest", "origin_city_name", "dest_city_name", "day_of_week",
        "pred_dep_time", "pred_elapsed_time",
    )


@query(with_views(f"""
    SELECT id, CASE WHEN prediction = 1 THEN 'Significant' ELSE 'Low' END AS risk,
        CAST(CAST(floor(probability * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS probability_text,
        CAST(id % 3000 AS VARCHAR) || ' mi' AS distance_text FROM scored""", "flights", labelled=LABELLED, scored=SCORED))
def result_presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(
        "id", risk_label(F.col("prediction") == 1).alias("risk"), percent_text(F.col("probability")).alias("probability_text"),
        miles_text(F.col("id") % 3000).alias("distance_text"),
    )


@query(with_views("""
    SELECT id, CASE WHEN probability * 1.1 > 1 THEN 'significant_delay_probability' ELSE 'fl_distance' END AS broken_field
    FROM scored WHERE probability * 1.1 > 1 OR id % 50 - 1 < 0""", "flights", labelled=LABELLED, scored=SCORED))
def result_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _scored(spark, sf_dir).select(
        "id", (F.col("prediction") == 1).alias("is_significant_delay"),
        (F.col("probability") * 1.1).alias("significant_delay_probability"), (F.col("id") % 50 - 1).alias("fl_distance"),
    )
    return contracts.result_violations(results).select("id", "broken_field")


@query(with_views(f"""
    SELECT {', '.join(f'CAST({name} AS VARCHAR) AS {name}' if name == 'flight_date' else name for name in MODEL_FEATURES)}
    FROM dataset""", "dataset"))
def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.scoring_features(_rows(spark, sf_dir).select(*MODEL_FEATURES))


SMALL_FOREST = {"numTrees": 10, "maxDepth": 6, "minInstancesPerNode": 10, "featureSubsetStrategy": "0.5", "subsamplingRate": 0.9}


def _training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete rows of the dataset with the test rows marked, stored as training reads them many times."""
    return stage(split.train_test(features.training_rows(_dataset(spark, sf_dir))), "training")


@query(None)
def rf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = _training_table(spark, sf_dir)
    path = scratch_path(spark, "model")
    training.save(training.fit(parted.where("NOT is_test"), **SMALL_FOREST), path)
    scored = training.predict(training.load(path), parted.where("is_test"))
    return scored.select("id", "significant", "prediction", "probability")


# One tree on all rows and features has known answers when the label depends on one feature alone.
ONE_TREE = {"numTrees": 1, "maxDepth": 2, "minInstancesPerNode": 1, "featureSubsetStrategy": "all", "subsamplingRate": 1.0, "bootstrap": False}
PLANTED = "day_of_week >= 4"
PLANTED_SQL = f"""
    SELECT id, CAST({PLANTED} AS INTEGER) AS significant FROM dataset WHERE {COMPLETE}"""


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete rows whose label is planted on the weekday, of which every fold has all seven."""
    rows = features.training_rows(_dataset(spark, sf_dir))
    return stage(rows.withColumn("significant", F.expr(f"CAST({PLANTED} AS INT)")), "planted")


@query(with_views("SELECT id, significant, significant AS prediction, CAST(significant AS DOUBLE) AS probability FROM planted",
                  "dataset", planted=PLANTED_SQL))
def planted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planted(spark, sf_dir)
    path = scratch_path(spark, "model")
    training.save(training.fit(rows, **ONE_TREE), path)
    return training.predict(training.load(path), rows).select("id", "significant", "prediction", "probability")


# A rare label, ten times as frequent late in the week: no tree is perfect, every vote is a fraction, and the two halves of the week are told
# apart by every tree (MLlib merges leaves that predict the same class).
BAGS, BAG_RATE = 5, 0.9
LATE = "day_of_week >= 4"
RARE = f"id % (CASE WHEN {LATE} THEN 4 ELSE 40 END) = 0"
BAGS_SQL = f"""
    SELECT id, late, significant, tree, CASE {" ".join(
        f"WHEN u < {limit!r} THEN {count}" for count, limit in enumerate(bagging.poisson_limits(BAG_RATE)))} END AS copies
    FROM (SELECT id, {LATE} AS late, CAST({RARE} AS INTEGER) AS significant, tree,
            ('0x' || substr(md5('bag1:' || tree || ':' || id), 1, 8))::BIGINT / 4294967296 AS u
        FROM (SELECT * FROM dataset WHERE {COMPLETE}), (SELECT unnest(range({BAGS})) AS tree))"""
BAG_WEIGHTS_SQL = """
    SELECT CAST(tree AS INTEGER) AS tree, significant, CAST(sum(copies) AS BIGINT) AS n,
        sum(sum(copies)) OVER (PARTITION BY tree) / (2 * sum(copies)) AS weight
    FROM bags GROUP BY tree, significant"""


def _rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.training_rows(_dataset(spark, sf_dir)).select("id", F.expr(f"CAST({LATE} AS DOUBLE)").alias("late"), F.expr(f"CAST({RARE} AS INT)").alias("significant"))
    return stage(VectorAssembler(inputCols=["late"], outputCol="features").transform(rows), "rare")


@query(with_views("SELECT tree, significant, n, round(weight, 9) AS weight FROM bag_weights", "dataset", bags=BAGS_SQL, bag_weights=BAG_WEIGHTS_SQL))
def bootstrap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagging.bootstrap_weights(_rare(spark, sf_dir), "id", BAGS, BAG_RATE).withColumn("weight", F.round("weight", 9))


@query(with_views("""
    SELECT r.id, r.significant, round(avg(v.vote), 9) AS probability, CAST(avg(v.vote) > 0.5 AS INTEGER) AS prediction
    FROM (SELECT DISTINCT id, late, significant FROM bags) r JOIN (
        SELECT b.tree, late, sum(copies * weight * b.significant) / sum(copies * weight) AS vote
        FROM bags b JOIN bag_weights w ON b.tree = w.tree AND b.significant = w.significant GROUP BY b.tree, late) v USING (late)
    GROUP BY r.id, r.significant""", "dataset", bags=BAGS_SQL, bag_weights=BAG_WEIGHTS_SQL))
def balanced_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees on the half of the week alone, each with the class weights of its own bootstrap: a leaf's vote is a weighted share."""
    rows = _rare(spark, sf_dir)
    grown = {"numTrees": BAGS, "subsamplingRate": BAG_RATE, "maxDepth": 2, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"}
    forest = bagging.BalancedForest(None, bagging.fit_trees(rows, "id", grown))
    return forest.vote(rows).select("id", "significant", F.round("probability", 9).alias("probability"), "prediction")


@query("""
    SELECT params, CAST(1 AS DOUBLE) AS mean_f1, CAST(0 AS DOUBLE) AS std_f1
    FROM (VALUES ('bootstrap=False,featureSubsetStrategy=all,maxDepth=1,minInstancesPerNode=1,numTrees=1,subsamplingRate=1.0'),
        ('bootstrap=False,featureSubsetStrategy=all,maxDepth=2,minInstancesPerNode=1,numTrees=1,subsamplingRate=1.0')) p(params)""")
def planted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.search(_planted(spark, sf_dir), [ONE_TREE, {**ONE_TREE, "maxDepth": 1}])


@query("""
    SELECT CAST(1 AS DOUBLE) AS best_cv_f1, CAST(1 AS DOUBLE) AS accuracy, CAST(1 AS DOUBLE) AS precision, CAST(1 AS DOUBLE) AS recall,
        CAST(1 AS DOUBLE) AS f1, CAST(1 AS DOUBLE) AS roc_auc,
        'bootstrap=False,featureSubsetStrategy=all,maxDepth=1,minInstancesPerNode=1,numTrees=1,subsamplingRate=1.0' AS params""")
def planted_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole training run over the dataset with delays planted on the weekday."""
    path = scratch_path(spark, "runs")
    delayed = _dataset(spark, sf_dir).withColumn("delay", F.expr(f"IF({PLANTED}, 60D, 0D)"))
    training.training_run(stage(delayed, "planted-dataset"), path, [ONE_TREE, {**ONE_TREE, "maxDepth": 1}])
    return spark.read.parquet(path).drop("run_at")


@query(None)
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    draws = [{**SMALL_FOREST, "numTrees": trees, "maxDepth": depth} for trees, depth in ((5, 4), (8, 6))]
    training.training_run(stage(_dataset(spark, sf_dir), "dataset"), path, draws)
    return spark.read.parquet(path).drop("run_at")


@query(None)
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _training_table(spark, sf_dir).where("NOT is_test")
    draws = [{**SMALL_FOREST, "numTrees": trees, "maxDepth": depth} for trees, depth in ((5, 4), (8, 6))]
    return training.search(train, draws)


@query(None)
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = training.fit(_training_table(spark, sf_dir).where("NOT is_test"), **SMALL_FOREST)
    return scoring.score_requests(_outcomes(spark, sf_dir), model)


# A label that the late half of the week makes likely and never certain: one split, and a probability that is a weighted share.
LIKELY = f"(id % 10 = 0) <> ({LATE})"


@query(with_views(f"""
    SELECT d.req_id, d.stage, d.status_code, d.message, share > 0.5 AS is_significant_delay, round(share, 9) AS significant_delay_probability,
        c.fl_distance, {", ".join(f"c.{name}" for name in scoring.RESPONSE_FIELDS)},
        CASE WHEN share IS NULL THEN '--' WHEN share > 0.5 THEN 'Significant' ELSE 'Low' END AS risk,
        coalesce(CAST(CAST(floor(share * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%', '--') AS probability_text,
        coalesce(CAST(c.fl_distance AS VARCHAR) || ' mi', '--') AS distance_text
    FROM coded d LEFT JOIN complete c USING (req_id) LEFT JOIN shares s ON s.late = (c.day_of_week >= 4)""",
    *LADDER_VIEWS, "airports", "dataset", **LADDER,
    likely=f"SELECT {LATE} AS late, CAST({LIKELY} AS INTEGER) AS significant FROM dataset WHERE {COMPLETE}",
    balance="SELECT significant, sum(count(*)) OVER () / (2 * count(*)) AS weight FROM likely GROUP BY significant",
    shares="SELECT late, sum(weight * l.significant) / sum(weight) AS share FROM likely l JOIN balance b ON l.significant = b.significant GROUP BY late"))
def planted_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole response to every request from a forest with known answers."""
    rows = stage(features.training_rows(_dataset(spark, sf_dir)).withColumn("significant", F.expr(f"CAST({LIKELY} AS INT)")), "likely")
    model = training.fit(rows, **{**ONE_TREE, "maxDepth": 1})
    scored = scoring.score_requests(_outcomes(spark, sf_dir), model)
    return scored.withColumn("significant_delay_probability", F.round("significant_delay_probability", 9))

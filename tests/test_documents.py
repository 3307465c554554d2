from __future__ import annotations

import json
import re
from datetime import date

import pytest

from tarmac.checks import views
from tarmac.fields import WEATHER_FIELDS
from tarmac.operators import features, matching
from tarmac.plans import scoring
from tarmac.sources.documents import stored_documents

SF = "/root/testdata/sf0.001"
PARSERS = ("parse_json", "from_json", "parseJson", "jsontostructs", "get_json_object")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def whole(value="1.5"):
    return json.dumps({"daily": {field: [value] for field in WEATHER_FIELDS}})


TEXTS = [None, "", "{}", " {} ", "not json", "[1]", "5", whole(), whole(2), whole(True), whole(None), whole("x"), whole({"a": 1}), whole("1e400"),
         json.dumps({"daily": {field: 3 for field in WEATHER_FIELDS}}), json.dumps({"daily": []}), json.dumps({"daily": None}),
         json.dumps({"daily": {field: [] for field in WEATHER_FIELDS}}), json.dumps({"daily": {"rain_sum": [1, 2]}, "more": "x" * 10000})]


@pytest.fixture
def responses(spark):
    rows = [(f"c{i}", date(2024, 1, 1), text, 503 if i == 3 else 200) for i, text in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "code string, date date, payload string, status_code int")


@pytest.mark.parametrize("read", [features.weather_values, scoring.strict_weather])
def test_stored_documents_read_like_texts(responses, read):
    stored = stored_documents(responses)
    text, paths = ({row.code: row for row in read(frame).collect()} for frame in (responses, stored))
    assert text == paths and len(text) == len(TEXTS)


def test_storing_twice_and_an_empty_table(responses):
    stored = stored_documents(responses)
    assert stored_documents(stored) is stored and "payload" not in stored.columns
    assert features.weather_values(stored_documents(responses.limit(0))).collect() == []


def test_no_text_is_parsed_and_only_paths_are_read(spark, responses):
    weather = plan(features.weather_values(stored_documents(responses)))
    assert not any(name in weather for name in PARSERS)
    schema = re.search(r"ReadSchema: (\S+)", weather).group(1)
    assert "variant" not in schema and "0:string" in schema
    pages = stored_documents(views.schedule_responses(spark, SF))
    documents = matching.schedule_documents(pages)
    for frame in (matching.schedule_rows(documents), matching.schedule_status(documents), scoring.strict_weather(stored_documents(responses))):
        assert not any(name in plan(frame) for name in PARSERS)


def test_common_fields_are_columns_of_the_file(responses):
    import pyarrow.parquet as pq

    path = stored_documents(responses.where("code = 'c7'").coalesce(1)).inputFiles()[0].removeprefix("file:")
    document = pq.ParquetFile(path).schema_arrow.field("document").type
    daily = document.field("typed_value").type.field("daily").type.field("typed_value").type
    assert {daily.field(i).name for i in range(daily.num_fields)} == set(WEATHER_FIELDS)

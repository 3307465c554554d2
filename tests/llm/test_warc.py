from __future__ import annotations

import gzip
import random
from collections import Counter
from pathlib import Path

import pytest

from tarmac.llm import warc
from tarmac.sources.portions import UnknownStore

ROWS = [(1, "http://B.example.com/x?q=1", "same"), (2, "http://a.example.com/", "same"), (3, None, "same"),
        (4, "http://a.example.com/ü y\r\n", None), (5, "not a url", ""), (6, "http://[broken", "üñí" * 20_000), (None, "http://z.org", "alone"),
        (7, "http://a.example.com/", "own"), (7, "http://a.example.com/", "own"), (None, None, "unnamed"), (None, None, "unnamed")]
SCHEMA = "page_id bigint, url string, html string, id string, sha1 string, keep string, size string"


def pages(spark, rows):
    return spark.createDataFrame([(*row, "x", "x", "x", "x") for row in rows], SCHEMA)


def expected(rows, least=0):
    keep = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            keep[html or ""] = max(i, keep.get(html or "", i))
    out = Counter()
    for i, _, html in rows:
        payload = (html or "").encode()
        to = keep.get(html or "")
        revisit = to is not None and i != to
        out[(i, len(payload), warc.digest(payload), "revisit" if revisit else "response", to if revisit else None)] += 1
    return out


@pytest.mark.parametrize("least", [0, 4, 5])
def test_round_trip(spark, least):
    rows = warc.round_trip(pages(spark, ROWS), least_bytes=least).collect()
    assert Counter(tuple(row)[:5] for row in rows) == expected(ROWS, least)


def test_index_is_ordered_over_partitions(spark):
    rows = [(i, f"http://h{i * 7 % 5}.example.com/p{i % 11}", f"page {i % 40}") for i in range(400)]
    df = pages(spark, rows).repartition(6)
    found = warc.round_trip(df).collect()
    keys = [(row.url_key, row.captured, str(row.page_id)) for row in found]
    assert keys == sorted(keys) and len(keys) == 400


def test_archives_are_readable_and_offsets_lead_to_records(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for row in warc.capture_index(warc.write(pages(spark, ROWS), folder), folder).collect():
        with open(Path(tmp_path) / row.archive, "rb") as file:
            file.seek(row.offset)
            content = gzip.decompress(file.read(row.length))
        assert content.startswith(b"WARC/1.1\r\n") and warc.parse(content)["payload_digest"] == row.payload_digest


def test_loser_tree_merges_any_runs():
    chance = random.Random(8)
    for count in (0, 1, 2, 3, 7, 16):
        runs = [sorted(chance.choices(range(20), k=chance.randrange(9))) for _ in range(count)]
        assert list(warc.LoserTree([iter(run) for run in runs], lambda x: x)) == sorted(x for run in runs for x in run)


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_merge_takes_column_batches():
    """Runs of three archives, cut into batches at other places, come out in one order."""
    chance = random.Random(5)
    runs = [sorted(((f"k{chance.randint(0, 40):02d}", None, None, 1, "d", "response", None, f"a{a}", 0, i, 1) for i in range(700)),
                   key=warc.order_key) for a in range(3)]
    rows = [row for run in runs for row in run]
    batches = [warc._batch(rows[start:start + 333]) for start in range(0, len(rows), 333)]
    merged = [row for batch in warc._merge(iter(batches)) for row in zip(*(values.to_pylist() for values in batch.columns))]
    assert merged == sorted(rows, key=warc.order_key)


def test_a_store_that_tasks_cannot_write_to_is_refused(spark):
    with pytest.raises(UnknownStore, match="viewfs"):
        warc.write(pages(spark, ROWS), "viewfs://x/archives")

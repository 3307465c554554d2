"""The registered text queries against plain versions over a whole small table."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarmac.llm import pii, queries, simhash, vectors, warc
from tests.llm.awkward import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").df()


def test_every_dealt_query_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def test_op2(spark):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    keep = {}
    for i, html in pages:
        keep[html or ""] = max(i, keep.get(html or "", i))
    expected = {(i, len((h or "").encode()), warc.digest((h or "").encode()), "response" if keep[h or ""] == i else "revisit",
                 None if keep[h or ""] == i else keep[h or ""]) for i, h in pages}
    assert {tuple(row)[:5] for row in queries.QUERIES["op2_archive_index"](spark, SF).collect()} == expected


def test_op3(spark, docs):
    rows = {row.doc_id: row for row in queries.QUERIES["op3_shape_field_pii"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for i, text in zip(docs.doc_id, docs.text):
        base = pii.base_spans(text or "")
        found = rows[i].spans.split(",") if rows[i].spans else []
        assert set(filter(None, pii.joined(base).split(","))) <= set(found)
        assert [rows[i][f"n_{kind}"] for kind in pii.KINDS] == [sum(x.startswith(f"{kind}:") for x in found) for kind in pii.KINDS]


def test_op4(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    labels = {row[0]: row[1:] for row in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()}
    documents, tokens = Counter(), Counter()
    for row in docs.itertuples():
        quality, toxic = labels.get(row.doc_id, (None, None))
        if toxic == 1:
            continue
        lines = row.text.split("\n")
        text = "\n".join(dict.fromkeys(lines)) if quality == 0 and toxic == 0 and len(set(lines)) < len(lines) else row.text
        documents[row.source, row.lang] += 1
        tokens[row.source, row.lang] += len(tokenizer.encode(text, add_special_tokens=False).ids)
    found = queries.QUERIES["op4_token_rollup"](spark, SF).collect()
    assert {(row.source, row.lang): (row.documents, row.tokens) for row in found} == {k: (documents[k], tokens[k]) for k in documents}


def test_op5(spark, docs):
    prints = {i: simhash.fingerprint(text) & (2**64 - 1) for i, text in zip(docs.doc_id, docs.text)}
    roots = components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    found = queries.QUERIES["op5_simhash_blocks"](spark, SF).collect()
    assert {tuple(row) for row in found} == {(i, f"{prints[i]:016x}", roots[i]) for i in prints}


def test_op1(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, total = set(), 0
    for i, text in zip(docs.doc_id, docs.text):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        total += len(ids)
        expected |= {(i, at // 2048, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes())) for at in range(0, len(ids), 2048)}
    rows = queries.QUERIES["op1_pattern_packing"](spark, SF).collect()
    assert len(rows) == len(expected)
    assert {(row.doc_id, row.piece, row.start, row.length, row.ids_crc32) for row in rows} == expected
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in sequences.values():
        places.sort()
        assert [at for at, _ in places] == [0, *np.cumsum([length for _, length in places])[:-1]]
        assert sum(length for _, length in places) <= 2048
    # No packing is under the number of tokens, nor under the number of pieces that fill over half a sequence.
    least = max(-(-total // 2048), sum(row.length > 1024 for row in rows))
    assert len(sequences) <= 1.02 * least + 1


@pytest.mark.parametrize("share", [0.0, 0.5])
def test_op7_finds_planted_pairs(spark, tmp_path, share):
    """Pairs just above the threshold, among vectors whose mean cosine is ``share``."""
    random = np.random.default_rng(11)
    common = random.standard_normal(64) / 8
    units = np.sqrt(share) * common / np.linalg.norm(common) + np.sqrt(1 - share) * random.standard_normal((1500, 64)) / 8
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    aside = random.standard_normal((500, 64))
    aside -= (aside * units[:500]).sum(axis=1, keepdims=True) * units[:500]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    table = np.vstack([units, 0.982 * units[:500] + np.sqrt(1 - 0.982 ** 2) * aside])
    spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(table)], "vec_id bigint, embedding array<double>, label int"
                          ).write.parquet(f"{tmp_path}/embeddings.parquet")
    close = table @ table.T >= vectors.COSINE * np.linalg.norm(table, axis=1)[:, None] * np.linalg.norm(table, axis=1)[None]
    np.fill_diagonal(close, False)
    found = {row.vec_id: row.n_links for row in queries.QUERIES["op7_itq_links"](spark, str(tmp_path)).collect()}
    links = np.array([found[i] for i in range(len(table))])
    assert close.sum() >= 1000 and (links <= close.sum(axis=1)).all() and links.sum() >= 0.95 * close.sum()


def test_op6_on_held_out_documents(spark, docs):
    rows = {row.doc_id: row for row in queries.QUERIES["op6_segmentation_langid"](spark, SF).collect()}
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in docs.doc_id)
    held = [(rows[i].lang_pred, lang) for i, lang in zip(docs.doc_id, docs.lang) if rows[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_op7(spark):
    table = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    units = np.array([np.array(v, dtype=float) / np.linalg.norm(v) for _, v, _ in table])
    labels = np.array([label for *_, label in table])
    close = (units @ units.T >= vectors.COSINE) & (labels[:, None] == labels[None])
    np.fill_diagonal(close, False)
    found = {row.vec_id: row for row in queries.QUERIES["op7_itq_links"](spark, SF).collect()}
    links = np.array([found[i].n_links for i, *_ in table])
    assert (links <= close.sum(axis=1)).all() and links.sum() >= 0.9 * close.sum()


def test_op9_on_held_out_documents(spark):
    at = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op9_string_kernel_toxicity"](spark, at).collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{at}/labels.parquet'").fetchall())
    held = [(row.score, labels[row.doc_id]) for row in rows if row.held_out and row.doc_id in labels]
    toxic, clean = (np.array([score for score, label in held if label == value]) for value in (1, 0))
    assert (toxic[:, None] > clean[None]).mean() > 0.9
    assert (clean >= 0.5).mean() < 0.03

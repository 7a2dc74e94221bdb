"""Every registered corpus query over a whole small table: contract columns, their types, a row for each row, and what can be told from the table alone."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from tailwatch.llm import queries
from tailwatch.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG, TEXT, INT, BOOL, REAL = "bigint", "string", "int", "boolean", "double"
CONTRACTS = {
    "op1_quality_rules": ("documents", {"doc_id": LONG, "n_words": LONG, "word_chars": LONG, "n_symbols": LONG, "n_dup_lines": LONG, "n_repeat_words": LONG, "base_failed": BOOL, "kept": BOOL}),
    "op2_source_mixing": ("documents", {"doc_id": LONG, "size": LONG, "source_size": LONG, "target": REAL, "taken": LONG}),
    "op3_kd_sharding": ("documents", {"doc_id": LONG, "size": LONG, "text_crc32": LONG, "law": TEXT, "shard": INT, "slot": LONG, "grown_shard": INT}),
    "op4_warc_packages": ("pages", {"page_id": LONG, "payload_bytes": LONG, "payload_digest": TEXT, "record_type": TEXT, "refers_to": LONG}),
    "op5_packing": (None, {"doc_id": LONG, "start": LONG, "length": LONG, "ids_crc32": LONG, "doc_tokens": LONG, "sequence_id": LONG, "offset": LONG}),
    "op6_minhash_near_dedup": ("documents", {"doc_id": LONG, "n_shingles": LONG, "component_id": LONG, "kept": BOOL}),
    "op7_language_id": ("documents", {"doc_id": LONG, "held_out": BOOL, "lang_pred": TEXT, "score": REAL}),
    "op8_pivot_near_dedup": ("embeddings", {"vec_id": LONG, "n_links": LONG, "component_id": LONG, "kept": BOOL}),
    "op9_token_store": ("documents", {"doc_id": LONG, "start": LONG, "n_tokens": LONG, "ids_crc32": LONG}),
    "op10_bwt_repeats": ("documents", {"doc_id": LONG, "n_bytes": LONG, "n_removed": LONG, "n_spans": LONG, "kept_sha256": TEXT}),
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def found(spark):
    kept = {}

    def rows(name):
        if name not in kept:
            out = queries.QUERIES[name](spark, SF)
            kept[name] = dict(out.dtypes), out.collect()
        return kept[name]

    return rows


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns_and_rows(spark, found, name):
    table, columns = CONTRACTS[name]
    kinds, rows = found(name)
    assert {c: kinds.get(c) for c in columns} == columns
    if table:
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_sizes_and_targets(found, docs):
    rows = found("op2_source_mixing")[1]
    size = {k: len(WORD.findall(d.text or "")) for k, d in docs.items()}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"] for r in rows)
    total, per, target, taken = sum(size.values()), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        source = docs[r.doc_id].source
        per[source] += r["size"]
        target[source] = r.target
        taken[source] += r.taken
    # weights 1, 2, 3, repeating, by source name with null last; capped at three times the size, the excess shared anew
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight, capped = {s: i % 3 + 1 for i, s in enumerate(names)}, set()
    while True:
        left = total - sum(3 * per[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * weight[s] / free > 3 * per[s]}
        if not over:
            break
        capped |= over
    want = {s: 3 * per[s] if s in capped else left * weight[s] / free for s in names}
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= max(0.05 * want[s], max(size.values())) for s in names)


def test_shards(found, docs):
    rows = found("op3_kd_sharding")[1]
    bytes_, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        text = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "bytes", None)
        bytes_[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(bytes_) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pieces_cover_every_document(found, docs):
    ids = {k: [*encoder().tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2] for k, d in docs.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found("op5_packing")[1]:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, total in [(p, len(ids[k])) for k, p in pieces.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 4096
    assert set(pieces) == set(docs)


def test_store_reads_back(found, docs):
    at = 0
    for r in sorted(found("op9_token_store")[1], key=lambda r: r.doc_id):
        ids = [*encoder().tokenizer.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += len(ids)


def test_languages_of_held_out_documents(found, docs):
    rows = found("op7_language_id")[1]
    for r in rows:
        text = docs[r.doc_id].text
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (text is None or not any(map(str.isalpha, text)))
    told = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].lang is not None and len(WORD.findall(docs[r.doc_id].text or "")) >= 20]
    assert sum(told) >= 0.9 * len(told)


def test_untouched_texts_keep_their_hash(found, docs):
    for r in found("op10_bwt_repeats")[1]:
        text = (docs[r.doc_id].text or "").encode()
        assert r.n_bytes == len(text) and (r.n_removed == 0) == (r.n_spans == 0) == (r.kept_sha256 == hashlib.sha256(text).hexdigest())

"""Decontamination, license scan, fingerprints, token counts and packing."""
import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.llm import chunk_prints, decontamination, kernels, license_scan, packing, token_counts
from glossa.llm.license_rules import required, rules, triggers
from glossa.llm.queries import tokenizer_path

from llm_helpers import CLASH, build, by_row

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute_contamination(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for _, text in texts:
        w, hit, ids = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[tuple(w[i:i + n])]
        out.append((len(w), len(hit), sorted(ids)))
    return out


@pytest.fixture(scope="module")
def items(edge_texts):
    by_id = dict(edge_texts)
    long = by_id[40].split(" ")
    return [(1, " ".join(long[100:140])), (2, " ".join(long[500:513])), (3, "two WORDS"), (4, "word"), (5, None), (6, "..."),
            (7, " ".join(long[100:120]) + " else"), (8, by_id[23]), (8, by_id[23]), (10, by_id[23]), (11, "nothing like it " * 9)]


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_contamination(spark, edge, edge_texts, items, block_words):
    """One block and several give the same result."""
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_row(decontamination.contamination(edge, bench, block_words=block_words))
    want = {}
    for (d, _), e in zip(edge_texts, brute_contamination(edge_texts, items)):
        want.setdefault(d, []).append(e)
    assert {d: sorted((r["n_words"], r["n_hit"], list(r["item_ids"])) for r in rs) for d, rs in got.items()} == \
        {d: sorted(rs) for d, rs in want.items()}


def test_contamination_of_rows_in_no_fixed_order(spark, edge, edge_texts, items):
    """Several blocks, over rows that every job deals anew: hits stay with their rows."""
    bench = spark.createDataFrame(items, "item_id long, text string")
    moving = edge.repartition(5, F.rand())
    got = decontamination.contamination(moving, bench, block_words=60).collect()
    want = sorted((d, *e) for (d, _), e in zip(edge_texts, brute_contamination(edge_texts, items)))
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in got) == want


def test_contamination_empty(spark, edge, empty, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontamination.contamination(edge, none).collect()} == {0}
    assert decontamination.contamination(empty, none).count() == 0
    kept = decontamination.drop_contaminated(edge, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == edge.columns and not {23, 4, 6} & {r["doc_id"] for r in kept.collect()}


LICENSES = [
    (1, "All Rights\nReserved. all rights   reserved"), (2, "CC-BY and cc by"), (3, "GNU General Public License, version 3."),
    (4, "Licensed under the Apache License, Version 2.0 and the MIT License"), (5, "accBy xcc by cc byx"), (6, "éall rights reserved"),
    (7, None), (8, ""), (9, "cc cc by by general public public license"), (10, "released under CC BY-SA 4.0"),
    (11, "Copyright (c) 2020 Someone All rights reserved"), (11, "Copyright (c) 2020 Someone All rights reserved"),
    (12, "word " * 5000 + "cc by " * 300), (13, "SPDX-License-Identifier: MPL-2.0"),
    (14, "This work is under Creative Commons Attribution-ShareAlike 4.0 International."), (15, "the FreeBSD License applies"),
]


def test_license_scan_against_sql(spark, edge_texts):
    against_sql(spark, LICENSES + [(1000 + d, t) for d, t in edge_texts])


def test_license_scan_values(spark):
    got = {d: r[0] for d, r in by_row(license_scan.license_scan(build(spark, LICENSES))).items()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 0, 3, "reserved")
    assert got[2]["n_base"] == 2 and got[2]["base_labels"] == "cc-by"
    assert got[3]["labels"] == "gpl,gpl-3"
    assert got[4]["labels"] == "apache-2.0,mit" and got[4]["n_base"] == 0
    assert got[5]["n_base"] == got[6]["n_base"] == 0 and got[5]["labels"] == ""
    assert (got[9]["n_base"], got[9]["first_word"]) == (1, 1)
    assert "cc-by-sa-4.0" in got[10]["labels"] and got[10]["base_labels"] == "cc-by"
    assert (got[12]["n_base"], got[12]["first_word"], got[12]["last_word"]) == (300, 5000, 5598)
    assert got[7]["n_words"] == 0 and got[7]["first_word"] is None and got[7]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in got.values())


CREATIVE = [
    (1, "This work is under Creative Commons Attribution-ShareAlike 4.0 International."), (2, "creative-commons attribution"),
    (3, "Creative\nCommons Attribution NonCommercial No Derivatives 3.0 Unported"), (4, "creative writing of the commons"),
]


def against_sql(spark, texts):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(texts, columns=["doc_id", "text"]).astype({"text": "object"}))
    got = license_scan.license_scan(build(spark, texts)).collect()
    rel = con.sql(license_scan.oracle())
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r[c] for c in rel.columns) for r in got), key=key) == sorted(rel.fetchall(), key=key)
    return {r["doc_id"]: r for r in got}


def test_license_scan_finds_creative_commons(spark, edge_texts):
    got = against_sql(spark, CREATIVE + [(1000 + d, t) for d, t in LICENSES + edge_texts])
    assert [got[i]["labels"] for i in (1, 2, 3, 4)] == ["cc-by-sa-4.0", "cc-by", "cc-by-nc-nd-3.0", ""]
    assert got[1]["score"] > 0


def test_license_scan_finds_freebsd(spark):
    got = against_sql(spark, [(1, "Under the FreeBSD License"), (2, "freebsd license of bsd"), (3, "freebsd")])
    assert [got[i]["labels"] for i in (1, 2, 3)] == ["bsd-2-clause", "bsd-2-clause", ""]


BODIES = [
    (1, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that: 1. "
        "Redistributions of source code must retain the above copyright notice.", "bsd,bsd-source-clause"),
    (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\")", "mit"),
    (3, "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY", "liability-disclaimer,warranty-disclaimer"),
    (4, "a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license",
     "patent-grant"),
    (5, "under the License; either version 2 of the License, or (at your option) any later version.", "or-later"),
    (6, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License", "gpl,lgpl"),
    (7, "This is free and unencumbered software released into the public domain.", "unlicense"),
    (8, "You may be held liable. Redistribution of warranties and advertising, without licence.", ""),
]


def test_license_scan_finds_licence_texts(spark):
    got = against_sql(spark, [(i, t) for i, t, _ in BODIES])
    assert {i: got[i]["labels"] for i, _, _ in BODIES} == {i: labels for i, _, labels in BODIES}


def test_every_rule_passes_its_own_gate():
    for r in rules():
        words = required(r.pattern)
        assert any(k in words or k == "licen" and any(w.startswith(k) for w in words) for k in r.keyword.split("|")), r


def test_every_rule_holds_a_trigger():
    for r in rules():
        assert any(t in w for t in triggers() for w in required(r.pattern)), r


def test_license_scan_stays_native_and_large(spark, empty):
    plan = license_scan.license_scan(build(spark, LICENSES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert len(rules()) > 300 and license_scan.license_scan(empty).count() == 0


def brute_edit(texts):
    rows = sorted(texts, key=lambda r: (r[0], r[1] or ""))
    out = {}
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        out.setdefault(d, []).append((len(t), hashlib.sha256((t[:len(t) - q] + after[:q]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("parts", [None, 1, 2])
def test_fingerprints(edge, edge_texts, parts):
    got = by_row(chunk_prints.edit_likeness(edge, parts=parts))
    assert {d: sorted((r["n_chars"], r["edited_sha256"]) for r in rs) for d, rs in got.items()} == \
        {d: sorted(rs) for d, rs in brute_edit(edge_texts).items()}
    texts = dict(edge_texts)
    same = {}
    for d, rs in got.items():
        for r in rs:
            assert same.setdefault(texts[d] or "", r["fingerprint"]) == r["fingerprint"]
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert got[10][0]["near_next"] == 1.0 and got[40][0]["near_edited"] > 0.7 and got[40][0]["near_next"] < 0.05
    assert got[1][0]["fingerprint"] == "" and got[1][0]["near_next"] == 1.0
    alone = {r["doc_id"]: r["fingerprint"] for r in chunk_prints.chunk_fingerprints(edge).collect()}
    assert all(alone[d] == rs[0]["fingerprint"] for d, rs in got.items())


def test_fingerprints_small_tables(spark, empty):
    assert chunk_prints.edit_likeness(empty).count() == 0
    one = chunk_prints.edit_likeness(build(spark, [(5, "only text of this table")])).collect()
    assert len(one) == 1 and one[0]["n_chars"] == 23


def test_chunks_cover_and_shift():
    text = ("some words that go on and on, " + "".join(random.Random(1).choices("abcdefghij klmno", k=3000)))
    data, at = kernels.flat(__import__("pyarrow").array([text, "", "new head " + text]))
    s, e = chunk_prints.chunks(data, at)
    assert (e - s).max() <= chunk_prints.MOST and (s[1:] >= e[:-1]).all() and (e - s).sum() == len(data)
    a, _, b = chunk_prints.prints([text, "", "new head " + text])
    assert chunk_prints.likeness(a, b) > 0.9


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(edge, edge_texts, name, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG_TEXT", 500)
    path = tokenizer_path(name)
    tok = token_counts.load(path)
    got = by_row(token_counts.token_counts(edge, path, limit=50))
    for d, t in edge_texts:
        t = t or ""
        n = len(tok.encode(t) if name.endswith(".model") else tok.encode(t, add_special_tokens=False).ids)
        assert all((r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 50) for r in got[d])
    assert sum(map(len, got.values())) == len(edge_texts)


def test_token_counts_small_cache(edge_texts):
    """Results do not depend on what the table of pieces holds."""
    import pyarrow as pa

    tok = token_counts.load(tokenizer_path())
    texts = [t or "" for _, t in edge_texts]
    for size in (10, 3000):
        pieces = token_counts.PieceIds(tok, size)
        for t in texts * 2:
            data, at = kernels.flat(pa.array([t]))
            s, e, _ = kernels.words(data, at, token_counts._SPACES)
            if len(s):
                of, ids, which = pieces.of(data, s, e)
                assert [int(x) for w in which for x in ids[of[w]:of[w + 1]]] == tok.encode(t, add_special_tokens=False).ids


def check_packing(texts, rows, max_tokens, max_segments=10 ** 9, max_loss=10 ** 9):
    import numpy as np

    tok = token_counts.load(tokenizer_path())
    ids = {}
    for d, t in texts:
        ids.setdefault(d, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    cover, sequences = {}, {}
    for r in rows:
        own = ids[r["doc_id"]][0]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes())
        cover.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["loss_tokens"]))
    for d, copies in ids.items():
        assert sum(n for _, n in cover[d]) == len(copies) * len(copies[0])
        if len(copies) == 1:
            at = 0
            for start, n in sorted(cover[d]):
                assert start == at
                at += n
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= max_tokens and len(parts) <= max_segments and sum(p[2] for p in parts) <= max_loss
        padding += 0 if at & (at - 1) == 0 else max_tokens - at
    return padding


def test_packing(edge, edge_texts):
    rows = packing.pack_documents(edge, tokenizer_path(), max_tokens=256).collect()
    assert check_packing(edge_texts, rows, 256) == 0


def test_packing_limits(spark, edge, edge_texts, monkeypatch):
    from pyspark.sql import functions as F

    docs = edge.withColumn("share", F.when(F.col("doc_id") % 2 == 0, 0.25))
    rows = packing.pack_documents(docs, tokenizer_path(), max_tokens=128, max_segments=3, max_loss=64, loss="share").collect()
    check_packing(edge_texts, rows, 128, 3, 64)


def test_token_operators_on_empty_tables(empty):
    assert token_counts.token_counts(empty, tokenizer_path()).count() == 0
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0
    assert CLASH


def plain_chunks(raw):
    """Content-defined chunks, byte by byte: a boundary after at least LEAST bytes where the hash of
    the last 32 bytes has enough leading zeros, more of them up to NORMAL bytes than after."""
    table = [int(x) for x in chunk_prints._GEAR]
    out, start = [], 0
    while start < len(raw):
        end = min(len(raw), start + chunk_prints.MOST)
        for size in range(chunk_prints.LEAST, end - start + 1):
            h = sum(table[b] << age for age, b in enumerate(reversed(raw[start + size - 32:start + size]))) & 0xFFFFFFFF
            bits = chunk_prints.STRICT_BITS if size <= chunk_prints.NORMAL else chunk_prints.LOOSE_BITS
            if h >> (32 - bits) == 0:
                end = start + size
                break
        out.append(raw[start:end])
        start = end
    return out


def test_fingerprints_against_plain_chunking(spark, edge, edge_texts):
    """Boundaries, digest sets and both likenesses, for every text and its successor."""
    raws = [(t or "").encode() for _, t in edge_texts]
    s, e = chunk_prints.chunks(*kernels.flat(pa.array([(t or "") for _, t in edge_texts], pa.large_string())))
    flat = b"".join(raws)
    assert [flat[a:b] for a, b in zip(s.tolist(), e.tolist())] == [c for raw in raws for c in plain_chunks(raw)]

    def likeness(own, other):
        mine, theirs = set(plain_chunks(own.encode())), set(plain_chunks(other.encode()))
        if not mine:
            return 0.0 if theirs else 1.0
        return sum(map(len, mine & theirs)) / sum(map(len, mine))

    unique = sorted(dict(edge_texts).items())
    docs = build(spark, unique)
    got = {r["doc_id"]: r for r in chunk_prints.edit_likeness(docs).collect()}
    for i, (d, t) in enumerate(unique):
        own, after = t or "", unique[(i + 1) % len(unique)][1] or ""
        n = len(own) // 4
        edited = own[:len(own) - n] + after[:n]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(own)
        assert got[d]["near_edited"] == pytest.approx(likeness(own, edited)) and got[d]["near_next"] == pytest.approx(likeness(own, after))
        marks = [x.split(":") for x in got[d]["fingerprint"].split(",") if x]
        assert sorted(int(n) for _, n in marks) == sorted(map(len, set(plain_chunks(own.encode()))))

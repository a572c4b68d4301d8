"""WARC packages, the prefix trie and whitening against brute force and round trips."""

import base64
import gzip
import hashlib
import io
import json
import random
import re
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import prefix_trie, warc, whitening
from tessella.session import shared_dir

PAGES = "page_id bigint, url string, html string, payload string, package string, _key int"


def pages(spark, rows):
    """Pages of (page_id, url, html) with columns whose names clash."""
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGES)


def written(spark, rows, **settings):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return warc.write_packages(warc.with_revisits(pages(spark, rows)), folder, **settings)


def records(spark, manifest, **settings):
    return {r["record_id"]: r for r in warc.read_records(warc.locate(manifest), **settings).collect()}


# 11 WARC


def test_warc_round_trip(spark):
    rng = random.Random(3)
    texts = ["", "<p>été \U0001f600</p>", "same " * 50, "long " * 300_000] + [f"page {i} " * rng.randint(1, 400) for i in range(60)]
    rows = [(i, f"http://a.example/{i}?q=a b\r\n", rng.choice(texts)) for i in range(300)] + [(900, None, None), (901, "u", "")]
    manifest = written(spark, rows, member_bytes=20_000, package_bytes=100_000)
    assert manifest.count() > 1 and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    got = records(spark, manifest)
    assert len(got) == len(rows)
    first = {}
    for i, _, t in rows:
        first[t or ""] = min(i, first.get(t or "", i))
    for i, url, t in rows:
        r, data = got[f"urn:x-page:{i}"], (t or "").encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r["url"] == (None if url is None else url.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A"))
        own = first[t or ""] == i
        assert r["record_type"] == ("response" if own else "revisit")
        assert r["refers_to"] == (None if own else f"urn:x-page:{first[t or '']}")
        assert r["payload"] == (data if own else None)


def test_warc_hot_payload(spark, monkeypatch):
    """A group above the share of hot groups is told apart by its broadcast winner alone."""
    rows = [(i, "u", "hot" if i % 3 else f"own {i // 6}") for i in range(5, 605)]
    got = records(spark, written(spark, rows), payloads=False)
    first = {}
    for i, _, t in rows:
        first[t] = min(i, first.get(t, i))
    assert sum(r["refers_to"] == "urn:x-page:5" for r in got.values()) == sum(t == "hot" for _, _, t in rows) - 1
    for i, _, t in rows:
        assert got[f"urn:x-page:{i}"]["refers_to"] == (None if first[t] == i else f"urn:x-page:{first[t]}")
        assert got[f"urn:x-page:{i}"]["payload"] is None


def test_warc_odd_tables(spark):
    assert written(spark, []).count() == 0
    assert records(spark, written(spark, [])) == {}
    rows = [(None, "u", "a"), (None, "u", "a"), (None, None, "b"), (None, None, "b"), (7, "u", "a"), (7, "u", "a")]
    got = warc.read_records(warc.locate(written(spark, rows))).select("record_id", "refers_to").collect()
    named = sorted((r[0], r[1] or "") for r in got)
    # Repeated rows of the smallest key are all responses; keyless rows refer to it, or stand by themselves.
    assert named == sorted([("urn:x-page:", "urn:x-page:7")] * 2 + [("urn:x-page:", "")] * 2 + [("urn:x-page:7", "")] * 2)
    least = warc.with_revisits(pages(spark, [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b"), (4, "u", "b")]), least_bytes=2).collect()
    assert {r["record_id"]: r["refers_to"] for r in least} == {"urn:x-page:1": None, "urn:x-page:2": "urn:x-page:1", "urn:x-page:3": None, "urn:x-page:4": None}


def opened(data):
    return pa.BufferReader(data)


def package(members, comment=b"", zip64=False, monkeypatch=None):
    if zip64:  # the writer then keeps all numbers in ZIP64 structures
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, how in members:
            z.writestr(zipfile.ZipInfo(name), data, how)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("how", ["index", "deflated index", "gzip index", "no index"])
def test_zip_directories(monkeypatch, zip64, how):
    made = [warc.record(f"urn:x:{i}", "http://u", warc.base32(hashlib.sha1(b"p%02d" % i).hexdigest()), 3, b"p%02d" % i, None) for i in range(40)]
    at, lines = 0, []
    for i, r in enumerate(made):
        lines.append(f"urn:x:{i} " + json.dumps({"offset": str(at), "length": str(len(r)), "filename": "a.warc.gz"}))
        at += len(r)
    index = ("\n".join(lines) + "\n").encode()
    members = [("datapackage.json", b"{}" * 9, zipfile.ZIP_DEFLATED), ("archive/a.warc.gz", b"".join(made), zipfile.ZIP_STORED)]
    if how == "gzip index":
        members.append(("indexes/index.cdx.gz", gzip.compress(index), zipfile.ZIP_STORED))
    elif how != "no index":
        members.append(("indexes/index.cdxj", index, zipfile.ZIP_DEFLATED if how.startswith("deflated") else zipfile.ZIP_STORED))
    data = package(members, b"a comment with PK\x05\x06 in it, and more words", zip64, monkeypatch)
    assert (b"PK\x06\x06" in data) == zip64
    found = list(warc.places(opened(data)))
    assert [warc.parse_record(data[a : a + n])["payload"] for _, a, n in found] == [b"p%02d" % i for i in range(40)]


def test_zip_damage(monkeypatch):
    with pytest.raises(ValueError, match="not a ZIP"):
        list(warc.places(opened(b"nothing")))
    with pytest.raises(ValueError, match="compressed as a whole"):
        list(warc.places(opened(package([("archive/a.warc.gz", b"x" * 50, zipfile.ZIP_DEFLATED)]))))
    assert list(warc.places(opened(package([])))) == []
    r = gzip.decompress(warc.record("urn:x:1", None, warc.base32(hashlib.sha1(b"abc").hexdigest()), 3, b"abc", None))
    assert warc.parse_record(gzip.compress(r))["payload"] == b"abc"
    for bad in (r.replace(b"abc", b"abd"), r.replace(b"abc", b"ab"), re.sub(rb"WARC-Payload-Digest: sha1:.", b"WARC-Payload-Digest: sha1:_", r)):
        with pytest.raises(ValueError):
            warc.parse_record(gzip.compress(bad))


# 12 prefix trie

TURNS = "conv_id bigint, turn bigint, role string, text string, path string, words int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)


def by_definition(rows):
    none = lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=none)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    built = {c: tuple(own.get(c - c % 20, [])[: h[c]] + v[h[c] :]) for c, v in own.items()}
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)
        ends = ",".join(str(c) for c in sorted(members) if built[c] == p)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), sum(map(leaf, below)),
                    sum((len(nodes[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, **settings):
    got = prefix_trie.prefix_trie(prefix_trie.with_shared_openings(prefix_trie.numbered_turns(turns(spark, rows))), **settings)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("shard", [1, 3, 4096])
def test_trie_by_brute_force(spark, shard):
    rng = random.Random(shard)
    say = [("user", "a b"), ("assistant", "ok"), ("user", "c d  e"), (None, "x"), ("u", None)]
    rows = []
    for c in [*range(0, 60), *range(100, 130), 140]:
        rows += [(c, None if rng.random() < 0.1 else t, *rng.choice(say[: 2 + c % 4])) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", "hot") for c in range(200, 260) for t in range(2)] + [rows[0], rows[0], (None, 1, "user", "nobody")]
    assert trie(spark, rows, shard=shard) == by_definition(rows)


def test_trie_hot_parents(spark):
    """More children than the share of a hot parent: all of them under the root, and under one opening."""
    rows = [(c, 0, "user", f"own {c}") for c in range(150)] + [(c, t, "user", "open" if t == 0 else f"then {c}") for c in range(1000, 1150) for t in range(2)]
    assert trie(spark, rows) == by_definition(rows)


def test_trie_odd_tables(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "user", "a")]) == []
    long = [(3, t, "user", "w " * 50_000 if t == 7 else str(t)) for t in range(900)]
    assert trie(spark, long) == trie(spark, long[::-1])
    # Conversation 41 borrows from an absent one and has too few turns of its own: nothing is left, but it is a member.
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(41, 60)}
    c = next(c for c in h if h[c] >= 1)
    assert trie(spark, [(c, 0, "user", "a")]) == by_definition([(c, 0, "user", "a")]) and len(trie(spark, [(c, 0, "user", "a")])) == 1


# 13 whitening

VECTORS = "vec_id bigint, embedding array<double>, x string, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)


@pytest.mark.parametrize("spectrum", ["random", "equal", "graded", "pairs", "rank one", "zero"])
def test_spectral_by_numpy(spectrum):
    rng = np.random.default_rng(5)
    n = 40
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    e = {"random": rng.random(n), "equal": np.ones(n), "graded": 10.0 ** -np.arange(n) * 1e6, "pairs": np.repeat(np.arange(1, n // 2 + 1), 2) * 1.0, "rank one": np.eye(1, n)[0], "zero": np.zeros(n)}[spectrum]
    a = (q * e) @ q.T
    values, v = whitening.spectral(a)
    size = max(np.abs(e).max(), 1e-300)
    assert np.allclose(values, np.sort(e)[::-1], atol=1e-13 * size)
    assert np.allclose(v.T @ v, np.eye(n), atol=1e-12)
    assert np.allclose(a @ v, v * values, atol=1e-12 * size)


def test_polar_factor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64):
        a = rng.standard_normal((n, n))
        a = a + a.T
        e, q = np.linalg.eigh(a)
        assert np.allclose(whitening.polar(a), (q * np.sign(e)) @ q.T, atol=1e-11)


def test_whitening_by_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 12)) * np.linspace(2, 0.1, 12)
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [1.0] * 11 + [None]), (1002, [1.0] * 11 + [float("nan")]), (1003, [float("inf")] * 12), (1004, []), (1005, [1.0] * 5)]
    got = whitening.whiten(vectors(spark, rows + bad + [rows[0], (None, rows[1][1])])).collect()
    kept = np.array([v for _, v in rows] + [rows[0][1], rows[1][1]])
    ints = np.floor(1024 * kept).astype(np.int64) + 100_000
    n = len(ints)
    cov = np.cov(ints.T.astype(float), bias=True)
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:8], q[:, ::-1][:, :8]
    want = (ints - ints.sum(0) / n) @ q / np.sqrt(e)
    of = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == 8 * n and len(of) == 8 * (n - 1) and {r["n"] for r in got} == {n}
    for c in range(8):
        mine = np.array([of[i, c + 1]["whitened"] for i in range(400)])
        sign = np.sign(mine @ want[:400, c])
        assert np.allclose(sign * mine, want[:400, c], atol=1e-9)
        assert abs(of[0, c + 1]["explained"] - e[c] / np.trace(cov)) < 1e-10
    for i in range(400):
        assert of[i, 1]["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(ints[i], ints.sum(0)))
    assert {r["identity_error"] for r in got}.pop() < 1e-10


def test_whitening_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"]) for r in sorted(one)] == [(1, 0, None, None), (2, 0, None, None)]
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in flat) and len(flat) == 27
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors(spark, [(1, [1e300])])).count()

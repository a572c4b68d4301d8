"""Corpus operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import bpe, chat_format, exact_dedup, hamming_topk, language_id, library_encoder, mixing, pii, simhash, substring_dedup, token_coder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, component_id int, spans string"


def docs(spark, rows):
    """Documents of (doc_id, text) with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 0, "y") for i, t in rows], SCHEMA)


ODD = [
    (1, "The cat sat on the mat and looked at the big red dog again."),
    (2, "the CAT sat on the mat and looked at the big red dog again."),
    (2, "the CAT sat on the mat and looked at the big red dog again."),
    (3, None),
    (4, ""),
    (None, "no id here"),
    (5, "word " * 30_000),
    (6, "Été à la plage. \U0001f600 <|endoftext|> ok\x00ok"),
    (7, "12 34 !!"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def sha(s):
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# 1 language ID


def test_language_held_out_accuracy(spark):
    got = language_id.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_code_lengths_by_definition():
    """The tables give the code lengths of the tree walked byte by byte."""
    import pandas as pd

    text = b"abracadabra abra cadabra"
    params = language_id.PpmParams(order=2, min_count=1, max_nodes=100)
    grams = pd.concat(list(language_id._ngrams(2)([pd.DataFrame({"lang": ["x"], "text": [text.decode()]})])))
    model = language_id.build(grams, params)
    count = lambda s: sum(text[i : i + len(s)] == s for i in range(len(text)))

    def bits(context, b):
        while True:
            follow = [count(context + bytes([c])) for c in range(256)]
            total, different = sum(follow), sum(f > 0 for f in follow)
            if total == 0:
                context = context[1:]
                continue
            if follow[b]:
                return -np.log2(follow[b] / (total + different))
            escape = -np.log2(different / (total + different))
            return escape + (bits(context[1:], b) if context else 8.0)

    for probe in (b"abracadabra", b"zzz", b"cab dab"):
        expected = sum(bits(probe[max(0, i - 2) : i], probe[i]) for i in range(len(probe)))
        assert language_id.code_lengths(model, [probe])[0, 0] == pytest.approx(expected, rel=1e-5)


def test_language_pieces_of_long_texts_add_up(monkeypatch):
    import pandas as pd

    grams = pd.concat(list(language_id._ngrams(3)([pd.DataFrame({"lang": ["x", "y"], "text": ["hello there " * 20, "guten tag " * 20]})])))
    model = language_id.build(grams, language_id.PpmParams(order=3, min_count=1))
    texts = [b"hello guten " * 50, b"", b"tag"]
    whole = language_id.code_lengths(model, texts)
    monkeypatch.setattr(language_id, "CHUNK", 37)
    assert language_id.code_lengths(model, texts) == pytest.approx(whole)


def test_language_odd_rows(odd, empty):
    rows = {(r["doc_id"], r["lang_pred"]): r for r in language_id.identify(odd).collect()}
    assert (3, "und") in rows and (4, "und") in rows and (7, "und") in rows and (1, "en") in rows
    assert language_id.identify(odd).count() == len(ODD) and language_id.identify(empty).count() == 0


# 2 exact top k


def brute_top_k(codes, queries, k):
    out = []
    for q, c in queries:
        near = sorted(((c ^ d) & (2**64 - 1)).bit_count() * 10**6 + i for i, d in codes if i != q)[:k]
        out += [(q, r + 1, x % 10**6, x // 10**6) for r, x in enumerate(near)]
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_top_k_by_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    codes = [(i, rng.choice(base) ^ (1 << rng.randrange(64)) * rng.randrange(2)) for i in range(300)] + [(900 + i, base[0]) for i in range(40)]
    df = spark.createDataFrame([(i, signed(c)) for i, c in codes] + [(5000, None)], "id bigint, code bigint")
    got = hamming_topk.top_k(df, df.where("id % 20 = 0"), 7)
    assert sorted(tuple(r) for r in got.collect()) == brute_top_k(codes, [x for x in codes if x[0] % 20 == 0], 7)


def test_top_k_few_rows(spark):
    df = spark.createDataFrame([(0, 5), (1, 4), (1, 4)], "id bigint, code bigint")
    assert [tuple(r) for r in hamming_topk.top_k(df, df.where("id = 0"), 10).collect()] == [(0, 1, 1, 1)]
    assert hamming_topk.top_k(df.limit(0), df.limit(0)).count() == 0


# 3 exact dedup


def test_exact_dedup_by_brute_force(spark, odd, empty):
    groups = {}
    for i, t in ODD:
        groups.setdefault(lower(t), []).append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = sorted(((i, top[lower(t)], len(groups[lower(t)]), i == top[lower(t)], sha(lower(t))) for i, t in ODD), key=str)
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(odd, salts=3).collect()), key=str) == expected
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_hot_group(spark):
    df = docs(spark, [(i, "Same" if i % 3 == 0 else f"text {i}") for i in range(600)]).repartition(9)
    kept = exact_dedup.exact_dedup(df).where("kept").select("doc_id").collect()
    assert {r[0] for r in kept} == {i for i in range(600) if i % 3} | {597}


def test_exact_dedup_stage_keeps_both_texts_of_one_id(spark):
    df = docs(spark, [(1, "one"), (1, "two"), (1, "ONE"), (2, "two"), (None, "three"), (3, None), (3, None)])
    kept = exact_dedup.stage_exact_dedup(spark, df, "")
    assert kept.columns == df.columns
    rows = sorted((r["doc_id"], lower(r["text"])) for r in kept.collect())
    assert rows == [(1, "one"), (2, "two"), (3, "")]
    again = exact_dedup.stage_exact_dedup(spark, df.repartition(5), "")
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))


# 4 substring dedup


def test_substring_dedup_by_brute_force(spark):
    got = {r["doc_id"]: r for r in substring_dedup.op4_substring_dedup(spark, SF).collect()}
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    seen, n = set(), 0
    for i, text in rows:
        spans = []
        for m in re.finditer(r"[^\n]+", text):
            line, at = m[0], 0
            for end in [e.end() for e in re.finditer(r"[.!?]+(?=\s)", line)] + [len(line)]:
                words = re.sub(r"[\W_]+", " ", line[at:end].casefold()).split()
                if len(words) >= substring_dedup.MIN_WORDS:
                    if tuple(words) in seen:
                        spans.append((m.start() + at, m.start() + end))
                    seen.add(tuple(words))
                at = end
        kept, last = [], 0
        for a, b in spans:
            kept.append(text[last:a])
            last = b
        n += len(spans)
        assert got[i]["n_removed"] == len(spans) and got[i]["removed_spans"] == ",".join(f"{a}:{b}" for a, b in spans)
        assert got[i]["kept_sha256"] == sha("".join([*kept, text[last:]]))
    assert len(got) == len(rows) and n > 0


def test_substring_dedup_inline_passage_and_odd_rows(spark, odd, empty):
    passage = "This passage of a good many words stands inside other text. It has a second sentence that is long enough too."
    df = docs(spark, [(1, f"Own start here. {passage} Own end."), (2, f"Different. {passage} Also other."), (3, "Nothing shared at all in this one, promise.")])
    made = {r["doc_id"]: r for r in substring_dedup.dedup_units(df).collect()}
    assert made[1]["removed"] == [] and len(made[2]["removed"]) == 2 and made[3]["removed"] == []
    assert made[2]["kept_text"] == "Different. Also other."
    rows = substring_dedup.dedup_units(odd).collect()
    assert len(rows) == len(ODD) and [len(r["removed"]) for r in rows if r["doc_id"] == 2] == [1, 1]
    assert substring_dedup.dedup_units(empty).count() == 0


# 5 chat formatting


def test_chat_round_trip_and_machine(spark):
    template = chat_format.ChatTemplate()
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|x", "a\\n\nb", "<", "|im_end|>", "", "\\<|\\"]
    turns = [("user", a) for a in nasty[:1]] + [x for a in nasty for x in (("assistant", a), ("user", a))] + [("assistant", nasty[0])]
    text, spans, problem = chat_format.format_conversation(turns, template)
    assert chat_format.parse(text, template) == turns and problem is None
    learned = [chat_format.unescape(text[a:b]) for a, b in zip(spans[::2], spans[1::2])]
    assert learned == [t for r, t in turns if r == "assistant"]
    assert chat_format.problems(["user", "user"], template) == "turn 1: user after user"
    assert chat_format.problems(["system", "user"], template) == "ends with user"
    assert "unknown role" in chat_format.problems(["robot"], template)
    rows = spark.createDataFrame([(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (None, None, None, None, 0), (2, 0, "ro\nle<|", "x", 0)], "conv_id bigint, turn bigint, role string, text string, formatted int")
    made = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(rows)).collect()}
    assert made[1]["valid"] and made[1]["loss_sha256"] == sha("b") and made[1]["turns_sha256"] == sha("user\n\nassistant\nb\n")
    assert not made[2]["valid"] and made[2]["turns_sha256"] == sha("ro\nle<|\nx\n") and made[None]["n_turns"] == 1
    assert chat_format.format_conversations(rows.limit(0)).count() == 0


# 6 byte-pair encoding


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(bpe.default_vocabulary())
    made.no_truncation()
    made.no_padding()
    return made


@pytest.mark.parametrize("encode", [bpe.encoder(bpe.default_vocabulary()).encode, library_encoder.encoder(bpe.default_vocabulary())])
def test_encoders_equal_the_library(spark, library, encode):
    rng = random.Random(7)
    pool = [chr(rng.randrange(32, 0x2FFF)) for _ in range(200)] + list("aaabcdeeefghiiilmnooprsttuu'' \n\t\x1c\x85 ſΣςİ½²ⅷ٣̀é") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'re", "<|", "\U0001f600", "\x00", "ing", "the"]
    texts = ["".join(rng.choice(pool if i % 2 else pool[200:]) for _ in range(rng.randrange(30))) for i in range(4000)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(40))) for _ in range(2000)] + ["a" * 5000, "ab" * 3000]
    texts += [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(100).collect()]
    for t in texts:
        assert encode(t) == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoded_rows(odd, empty, library):
    rows = bpe.encode_documents(odd, with_ids=True).collect()
    texts = {(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD}
    assert {(r["doc_id"], r["n_tokens"]) for r in rows} == texts and len(rows) == len(ODD)
    for r in rows:
        assert r["ids_sha256"] == sha(" ".join(map(str, r["ids"]))) and r["decoded_sha256"] == sha(library.decode(r["ids"], skip_special_tokens=False))
    assert bpe.encode_documents(empty).count() == 0


# 7 mixing


def test_raking_meets_targets(spark):
    rows = [(s, g, t, (1 + i * 7 + j * 3 + k) * 10) for i, s in enumerate("abc") for j, g in enumerate(["en", "de"]) for k, t in enumerate(["x", "y"])]
    cells = spark.createDataFrame([*rows, ("d", "en", "x", 0)], "source string, lang string, topic string, tokens bigint")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2, "absent": 9.0}, "lang": {"en": 0.25, "de": 0.75}, "topic": {"x": 0.6, "y": 0.4}}
    targets["source"].pop("absent")
    made = mixing.rake(cells, mixing.MixParams(targets=targets, rounds=12)).collect()
    for d, goal in targets.items():
        total = {}
        for r in made:
            total[r[d]] = total.get(r[d], 0) + r["share"]
        assert all(total[v] == pytest.approx(share, abs=1e-4) for v, share in goal.items())


def test_mixing_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["probability"] <= 1 for r in rows) and max(r["probability"] for r in rows) == 1
    assert mixing.mix(empty).count() == 0


# 8 near-duplicates


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes):
    root = {v: v for v in nodes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in nodes}


def test_fingerprints_and_components(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    by_id = {}
    for i, t in ODD:
        by_id.setdefault(i, set()).add(format(brute_fingerprint(t), "016x"))
    assert all(r["fingerprint"] in by_id[r["doc_id"]] for r in rows) and len(rows) == len(ODD)
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert found[2] == 1 and found[4] == 3 and found[5] == 5
    assert simhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_documents_by_brute_force(spark):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op8_simhash_near_dedup(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    root = brute_components(sorted(set(prints.values())))
    smallest = {}
    for i, v in prints.items():
        smallest[root[v]] = min(i, smallest.get(root[v], i))
    assert got == {i: (format(v, "016x"), smallest[root[v]]) for i, v in prints.items()}


@pytest.mark.parametrize("cap", [1, 4, 32])
def test_links_whatever_the_cell_cap(spark, cap):
    rng = random.Random(cap)
    nodes = set()
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(25):  # a chain of near fingerprints, crowded cells
            nodes.add(v)
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    nodes |= {0, 1, 3, (1 << 63), (1 << 64) - 1} | {0b111 << i for i in range(0, 60, 5)}
    df = spark.createDataFrame([(signed(v),) for v in nodes], "fp bigint")
    links = simhash.close_fingerprints(df, cell_cap=cap)
    pairs = links.collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in pairs)
    groups = {}
    for v, root in brute_components(sorted(nodes)).items():
        groups.setdefault(root, set()).add(v)
    expected = {frozenset(g) for g in groups.values() if len(g) > 1}
    got = {}
    for r in simhash.components(links).collect():
        got.setdefault(r["root"], set()).add(r["node"] & (2**64 - 1))
    assert {frozenset(g) for g in got.values()} == expected


def test_manhattan_never_exceeds_hamming(spark):
    rng = random.Random(9)
    rows = [(signed(a := rng.getrandbits(64)), signed(a ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)))) for _ in range(500)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    bound = F.bit_count(simhash.thermometer(F.col("a")).bitwiseXOR(simhash.thermometer(F.col("b"))))
    counts = lambda x: [((x >> s) & 3).bit_count() for s in range(0, 64, 2)]
    for r in df.select("a", "b", bound.alias("m"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("h")).collect():
        assert r["m"] == sum(abs(p - q) for p, q in zip(counts(r["a"] & (2**64 - 1)), counts(r["b"] & (2**64 - 1)))) <= r["h"]


# 9 personal data


def base_by_rule(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, *m.span()) for k, p, ok in tests for m in re.finditer(p, text) if ok(m[0])]


def test_base_spans_by_rule(spark):
    rng = random.Random(3)
    parts = ["@", ".", "a", "b1", "x.y", "+1 ", "(98", ") 555", "-", " ", "4111 1111 1111 1111", "1.2.3.4", "256", "127.0.0.1", ".5", "me@site.co.uk", "a@b@c.d", "+49 (30) 1234567", "é", "\n", "0", "12345678"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(6000)]
    texts += [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in texts:
        assert [(k, a, b) for k, a, b, _ in pii.find(t) if k in pii.BASE] == base_by_rule(t), repr(t)


def test_checksums_context_and_odd_rows(odd, empty):
    assert [s[0] for s in pii.find("account DE89 3704 0044 0532 0130 00 today")] == ["iban"]
    assert pii.find("account DE89 3704 0044 0532 0130 01 today") == []
    assert [s[0] for s in pii.find("social security 123-45-6789")] == ["ssn"] and pii.find("order 123-45-6789") == []
    assert pii.personal_data(odd).count() == len(ODD) and pii.personal_data(empty).count() == 0
    for run in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 60_000):  # linear on long runs
        pii.find(run)


# 10 token-id files


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(4)
    for spread in (2, 300, 65_536):
        made = [rng.integers(0, spread, rng.integers(0, 5000)).astype(np.uint16) for _ in range(6)] + [np.empty(0, np.uint16)]
        ids = [None, *range(10**12, 10**12 + 6)]
        data = token_coder.pack(ids, made)
        back, tokens = token_coder.unpack(data)
        assert back == ids and all((a == b).all() for a, b in zip(made, tokens))
        for at in (60, len(data) // 2, len(data) - 20):
            bad = bytearray(data)
            bad[at] ^= 0x10
            with pytest.raises(ValueError):
                token_coder.unpack(bytes(bad))
    assert token_coder.unpack(token_coder.pack([], [])) == ([], [])


def test_a_block_is_coded_alike_beside_any_others():
    rng = np.random.default_rng(6)
    blocks = [rng.integers(0, 500, n).astype(np.uint16) for n in (40, 4096, 1, 900)]
    together = token_coder.encode_blocks(blocks)
    assert [token_coder.encode_blocks([b])[0] for b in blocks] == together


def test_a_document_of_more_blocks_than_are_coded_at_once(monkeypatch):
    monkeypatch.setattr(token_coder, "SEGMENT_BLOCKS", 2)
    made = [np.arange(5 * token_coder.BLOCK + 7, dtype=np.uint16), np.array([2], np.uint16)]
    back, tokens = token_coder.unpack(token_coder.pack([1, 2], made))
    assert back == [1, 2] and all((a == b).all() for a, b in zip(made, tokens))


def test_coding_of_blocks_is_cheap():
    """Coding and decoding within 1.2 microseconds of CPU an id, by the time a plain loop takes here."""
    rng = np.random.default_rng(7)
    blocks = [(rng.zipf(1.3, 640) % 5000).astype(np.uint16) for _ in range(1024)]
    took = []
    for _ in range(3):
        t0 = time.thread_time()
        sum(range(1_000_000))  # about 20 ms on a machine of usual speed
        t1 = time.thread_time()
        back = token_coder.decode_blocks(token_coder.encode_blocks(blocks), [len(b) for b in blocks])
        took.append((time.thread_time() - t1) / (50 * (t1 - t0)))
        assert all((a == b).all() for a, b in zip(blocks, back))
    assert min(took) < 1.2e-6 * sum(map(len, blocks))


def test_runs_of_a_batch_as_whole_texts(library):
    texts = ["Don't stop,now. 1.2.3!! (a,b) e.g.:x", "<|ENDOFTEXT|> a", "a<|endoftext|>b", "\x01 a\x01b", "a\x1cb", "É,é.Ñandú;", "", "Σας, ΣΑΣ. e\u0301,x", "a\xa0b\x85c,d"]
    encode = library_encoder.RunEncoder(bpe.default_vocabulary())
    for _ in range(2):  # new, then known
        ids, sizes = encode.batch(texts)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, odd, empty, library):
    got = sorted((tuple(r) for r in token_coder.read_tokens(token_coder.write_tokens(odd)).collect()), key=lambda r: r[1])
    at = 0
    for (i, t), r in zip(sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert r == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(ODD) and token_coder.read_tokens(token_coder.write_tokens(empty)).count() == 0


def test_token_ids_of_documents_by_the_library(spark, library):
    got = sorted((tuple(r) for r in token_coder.op10_token_ids(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    at, want = 0, []
    for i, t in sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want

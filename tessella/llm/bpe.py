"""BPE encoding and decoding in linear time.

A byte-pair encoding of a word is the one token sequence in which every two neighbours are
compatible: merging by rank would leave the boundary between them alone. The encoder walks a word
from the left. An Aho-Corasick automaton gives all tokens that occur in the word, so the longest
token at each position and the shorter ones are known; the longest that is compatible with the
token before is taken, and when none is, the last token is given back and its next shorter
alternative is tried. A position from which the end cannot be reached is not tried again, so the
work is linear in the word's length. Compatibility of a pair is decided by undoing the merges of
both tokens, newest first, and is kept in a table.

The vocabulary files hold words: text is normalised and split before encoding, and the last
character of a word carries an end mark. Words repeat, so each task keeps a bounded cache of encoded
words. Decoding gathers token strings from one long string by an offset table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.normalizers import NFC

from tessella.llm.common import documents, text_batches

#: Words a task remembers; beyond that it starts again.
#: Entries of each table of what was encoded before; a Python worker keeps them.
CACHE_WORDS = 150_000
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that str.split() takes for white space and the vocabulary's rule does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte, by the rule of byte-level BPE."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    out, extra = [""] * 256, 256
    for b in plain:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b], extra = chr(extra), extra + 1
    return out


class WordSplitter:
    """Normalises a text and splits it into words, as the vocabulary file says.

    Special tokens are cut out first. ``chunks`` are runs without white space; the caller may keep
    what a chunk gave, as a chunk is split alike wherever it stands.
    """

    def __init__(self, spec: dict):
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = pattern.replace(r"[^\s", f"[^{_SPACE}")
        self.words = regex.compile(self.pattern)
        self._exact: regex.Pattern | None = None

    def pieces(self, text: str) -> Iterator[int | list[str]]:
        """Ids of special tokens, and lists of chunks, in order."""
        for part in self.cut.split(text) if self.cut and "<|" in text else [text]:
            if part in self.special:
                yield self.special[part]
            elif part:
                if not part.isascii():
                    # Marks of newer Unicode versions are ordered as the library orders them.
                    part = unicodedata.normalize("NFC", part) if max(part) < "\u0250" else NFC().normalize_str(part)
                    part = part.replace("Σ", "σ")  # lower-cased alike at a word's end
                low = part.lower()
                yield low.split() if not _NOT_SPACE.search(low) else re.split(f"[{_SPACE}]+", low)

    def split(self, chunk: str) -> list[str]:
        if chunk.isascii() or max(chunk) < "\u0250":
            return self.words.findall(chunk)
        if self._exact is None:
            self._exact = regex.compile(self._settled(), regex.V1)
        return self._exact.findall(chunk)

    def _settled(self) -> str:
        """The pattern without characters that newer Unicode versions than Python's have added."""
        new = "".join(chr(c) for c in range(0x250, 0x110000) if unicodedata.category(chr(c)) == "Cn" and regex.match(r"[\p{L}\p{N}]", chr(c)))
        return self.pattern.replace(r"[\p{L}]", rf"[\p{{L}}--[{new}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{new}]]").replace(r"\p{L}\p{N}]+", rf"\p{{L}}\p{{N}}]|[{new}])+").replace(f"[^{_SPACE}", f"(?:[^{_SPACE}") if new else self.pattern


class BacktrackingBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.splitter = WordSplitter(spec)
        model = spec["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank of the merge
        for r, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a.removesuffix(self.mark) + b if self.mark and a.endswith(self.mark) else a + b]
            self.rank[pair], self.made[pair] = r, whole
            self.parts.setdefault(whole, (*pair, r))
        self.alphabet = byte_alphabet()
        self.pair_ok: dict[tuple[int, int], bool] = {}
        # Offset table: token i is joined[offset[i]:offset[i + 1]].
        strings = dict(sorted({**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.splitter.special.items()}}.items()))
        size = max(strings) + 1
        self.joined, self.offset = "", [0]
        self.joined = "".join(strings.get(i, "") for i in range(size))
        for i in range(size):
            self.offset.append(self.offset[-1] + len(strings.get(i, "")))
        # The end mark is one character of its own here, so that a token that ends a word only matches there.
        self.end = "\ue000"
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if self._reachable(i):
                own = token[: -len(self.mark)] + self.end if self.mark and token.endswith(self.mark) and len(token) > len(self.mark) else token
                self.automaton.add_word(own, (i, len(own)))
        self.automaton.make_automaton()
        self.strings = [self.joined[a:b] for a, b in zip(self.offset, self.offset[1:])]
        self._cache: dict[str, tuple[int, ...]] = {}
        self._words: dict[str, tuple[int, ...]] = {}

    def _reachable(self, token: int) -> bool:
        """Merging by rank gives the token for its own string."""
        if token not in self.parts:
            return True
        a, b, _ = self.parts[token]
        return self._reachable(a) and self._reachable(b) and self.compatible(a, b, self.parts[token][2])

    def compatible(self, a: int, b: int, limit: int | None = None) -> bool:
        """Nothing merges across the boundary of a and b (before the merge of rank ``limit``)."""
        if limit is None:
            known = self.pair_ok.get((a, b))
            if known is not None:
                return known
            if len(self.pair_ok) > 4 * CACHE_WORDS:
                self.pair_ok.clear()
            out = self.pair_ok[(a, b)] = self._boundary_holds(a, b, len(self.rank))
            return out
        return self._boundary_holds(a, b, limit)

    def _boundary_holds(self, a: int, b: int, limit: int) -> bool:
        """Undo the merges of both sides, newest first, and look for a merge over the boundary that
        would have come before the newest one undone so far, or on equal rank stood further left."""
        inclusive = False
        while True:
            r = self.rank.get((a, b))
            if r is not None and (r < limit or (inclusive and r == limit)):
                return False
            ra = self.parts[a][2] if a in self.parts else -1
            rb = self.parts[b][2] if b in self.parts else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the merge inside a goes first when it stands left of the boundary's
                a, limit, inclusive = self.parts[a][1], ra, False
            else:
                b, limit, inclusive = self.parts[b][0], rb, True

    def word(self, word: str) -> tuple[int, ...]:
        """Token ids of one word of the splitter."""
        text = "".join([self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")]) + (self.end if self.mark else "")
        found = [m for _, m in self.automaton.iter_long(text)]  # longest token, again and again
        if sum([size for _, size in found]) < len(text):
            return self._backtrack(text)
        greedy, known = [token for token, _ in found], self.pair_ok
        for pair in zip(greedy, greedy[1:]):
            if not (known[pair] if pair in known else self.compatible(*pair)):
                return self._backtrack(text)
        return tuple(greedy)

    def _backtrack(self, text: str) -> tuple[int, ...]:
        n = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in text]  # tokens that start here, longest last
        for last, match in self.automaton.iter(text):
            at[last - match[1] + 1].append(match)
        known, compatible = self.pair_ok, self.compatible
        dead = bytearray(n + 1)
        path: list[tuple[int, int, int]] = []  # position, alternatives left there, token
        pos, left, before = 0, len(at[0]), -1
        while pos < n:
            found = at[pos]
            while left:
                left -= 1
                token, size = found[left]
                if not dead[pos + size]:
                    pair = (before, token)
                    if before < 0 or (known[pair] if pair in known else compatible(before, token)):
                        path.append((pos, left, token))
                        pos, before = pos + size, token
                        left = len(at[pos]) if pos < n else 0
                        break
            else:
                if not path:
                    raise ValueError(f"no encoding for {text!r}")
                # The text up to here has one encoding, so its last token is settled and nothing
                # that fits after it was found: no other way leads on from this position.
                dead[pos] = 1
                pos, left, _ = path.pop()
                before = path[-1][2] if path else -1
        return tuple([token for _, _, token in path])

    def chunk(self, chunk: str) -> tuple[int, ...]:
        words, cache = self.splitter.split(chunk), self._words
        out: list[int] = []
        for w in words:
            ids = cache.get(w)
            if ids is None:
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                ids = self.word(w)
                if len(w) <= 64:
                    cache[w] = ids
            out += ids
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        cache, out = self._cache, []
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for piece in self.splitter.pieces(text):
            if isinstance(piece, int):
                out.append(piece)
                continue
            for c in piece:
                ids = cache.get(c)
                if ids is None:
                    ids = self.chunk(c)
                    if len(c) <= 64:
                        cache[c] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Token strings with a space between, as files without a decoder ask for."""
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> BacktrackingBpe:
    """One encoder per process and vocabulary file."""
    return BacktrackingBpe(path)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encoded(path: str, with_ids: bool) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        names = list(map(str, range(len(bpe.offset))))
        for texts in batches:
            rows = []
            for text in texts:
                ids = bpe.encode(text or "")
                row = (len(ids), _sha256(" ".join(map(names.__getitem__, ids))), _sha256(bpe.decode(ids)))
                rows.append((*row, ids) if with_ids else row)
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return run


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_tokens, ids_sha256, decoded_sha256,
    and with ``with_ids`` also ids (array of int).

    Null texts count as empty: no token, digests of the empty string. Repeated rows are encoded each;
    doc_id may be null. The file at ``path`` must be readable in every task.
    """
    kind = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    encode = F.pandas_udf(encoded(path or default_vocabulary(), with_ids), kind)
    return docs.select("doc_id", encode("text").alias("_e")).select("doc_id", "_e.*")


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with their digests: the end of the pipeline.

    Null texts count as empty and have no ids; repeated rows are encoded alike; texts of any length are encoded
    whole; other columns are left out. An empty table gives an empty result.
    """
    text_batches(spark)
    return encode_documents(docs, with_ids=True)

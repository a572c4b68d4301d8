"""Token ids by the tokenizers library, each distinct piece of text encoded once per task.

A vocabulary that drops white space encodes a run of other characters alike wherever it stands. The
runs of a batch of texts are numbered by Arrow, looked up in a bounded table, and only new ones go to
the library, all in one text with a control character between them. What the library's own rules do not
treat run by run goes to it whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Runs a Python worker remembers; beyond that it starts again.
CACHE_RUNS = 600_000
#: Stands between runs in a text for the library.
_BETWEEN = "\x01"
#: Texts with that character, with separators that only Arrow takes for white space, or with characters from
#: U+0250 on, whose neighbours may change them.
_BEYOND = "[\x01\x1c-\x1fɐ-\U0010ffff]"
#: A letter or digit and what never goes with it: apart, there are fewer distinct runs.
_WORD_END = "([a-z0-9])([,.;:!?])"


class RunEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [x["content"].lower() for x in spec.get("added_tokens", [])]
        self.between = self.whole(_BETWEEN)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start = np.zeros(1, np.int64)  # of each known run in ``ids``, and the end of the last
        self.ids = np.empty(0, np.uint16)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def _learn(self, runs: list[str]) -> None:
        """Encodes new runs and adds them to the table."""
        if len(self.between) == 1:
            made = self.whole(f" {_BETWEEN} ".join(runs))
            cuts = np.flatnonzero(made == self.between[0])
            ids = np.delete(made, cuts)
            ends = np.append(cuts - np.arange(len(cuts)), len(ids))
        else:
            each = [self.whole(r) for r in runs]
            ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        self.known.update(zip(runs, range(len(self.known), len(self.known) + len(runs))))
        self.start = np.concatenate([self.start, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])

    def batch(self, batch: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        texts = pa.array(batch, pa.large_string())  # a new array: ascii_lower fails on slices
        low = pc.ascii_lower(texts)
        odd = pc.match_substring_regex(texts, _BEYOND)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(low, s))
        apart = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        low = pc.replace_with_mask(low, odd, pa.scalar("", pa.large_string()))
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(low, _WORD_END, r"\1 \2"))
        numbered = lists.flatten().dictionary_encode()
        runs = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE_RUNS:
            self._clear()
        new = [r for r in runs if r not in self.known]
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))
        begin, size = self.start[rows], self.start[rows + 1] - self.start[rows]
        at = numbered.indices.to_numpy(zero_copy_only=False)
        sizes = size[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(begin[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.append(0, ends)[lists.offsets.to_numpy()]
        if not len(apart):
            return ids, np.diff(upto)
        parts = np.split(ids, upto[1:-1])
        for i in apart.tolist():
            parts[i] = self.whole(texts[i].as_py())
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


@lru_cache(maxsize=2)
def runs(path: str) -> RunEncoder:
    """One encoder per process and vocabulary file."""
    return RunEncoder(path)


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of one text."""
    return lambda text: runs(path).batch([text])[0].tolist()

"""Token ids of many texts: each distinct stretch between blanks is encoded once for a chunk of texts.

A byte-level tokenizer with the usual word pattern never joins a character that is not white space with a
blank after it, and a tokenizer that drops white space joins nothing across it. So the ids of a text are the
ids of its stretches one after the other, and a chunk's distinct stretches are far fewer than its words. A
stretch is cut once more where a punctuation mark follows a letter, and around a line break between words, as
both kinds of tokenizers begin a new word there. Tokenizers of other makes get whole texts.

Cutting and numbering of stretches are Arrow kernels; the library encodes the pieces that a process has not
met yet, and a bounded dictionary keeps their ids for the next chunks.
"""

from __future__ import annotations

import functools
import json
import os
import re
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: White space of any kind, for RE2, whose own class knows the ASCII ones only.
_SPACE = r"\t-\r\x1c-\x20\x{85}\pZ"
#: Stands between the pieces of a stretch; stretches that hold it are not cut.
_MARK = "\x00"

#: Pieces that every step before the model leaves as they are: letters that are lower-case and composed already
#: where that matters, with their blank where it belongs to them.
_PLAIN = {
    ("led", False): "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$",
    ("bare", True): "^[a-zß-öø-ÿ]+$",
    ("bare", False): "^[A-Za-zÀ-ÖØ-öø-ÿ]+$",
}


def _number(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each value among the distinct ones, and these."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _take(lists: pa.LargeListArray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists[at[0]], lists[at[1]] ... as one array, and where each begins, with the end."""
    out = lists.take(pa.array(at))
    starts = out.offsets.to_numpy()
    return out.values.to_numpy()[starts[0] : starts[-1]], starts - starts[0]


class Encoder:
    """Encodes texts with a tokenizer file of the tokenizers library; special strings are ordinary text."""

    def __init__(self, path: str, kept: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kept = kept
        self._forget()
        plan = json.loads(self.tokenizer.to_str())
        pre, norm = plan["pre_tokenizer"] or {}, plan["normalizer"] or {}
        plain = not any(not t["special"] for t in plan["added_tokens"])
        first = (pre.get("pretokenizers") or [{}])[0]
        steps = [(x.get("type"), x.get("content")) for x in norm.get("normalizers", [norm] if norm else [])]
        known = {("NFC", None), ("Replace", " "), ("Lowercase", None)}
        #: "led": a stretch takes the blank before it along; "bare": white space is dropped; "whole": no stretches
        self.kind = "whole"
        if plain and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not steps:
            self.kind = "led"
        elif plain and first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and r"[^\s\p{L}\p{N}]" in first["pattern"].get("Regex", "") and set(steps) <= known:
            self.kind = "bare"
        #: the same model without the steps before it, for pieces of plain letters, which these leave as one word
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(_MARK, "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = self.bare.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None  # no piece of letters has this id
        self.lowers = self.kind == "bare" and ("Lowercase", None) in steps

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    @staticmethod
    def _by_library(tokenizer: object, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n): the ids of all units one after the other, and how many each has."""
        ids: list[int] = []
        n: list[int] = []
        for k in range(0, len(units), 5000):
            for x in tokenizer.encode_batch_fast(units[k : k + 5000], add_special_tokens=False):
                own = x.ids
                ids += own
                n.append(len(own))
        return np.array(ids, np.uint32), np.array(n, np.int64)

    def _plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _by_library, for pieces of plain letters: many go to the library as one text, with marks between them."""
        if self.mark is None:
            return self._by_library(self.bare, units)
        texts = [_MARK.join(units[k : k + 64]) + _MARK for k in range(0, len(units), 64)]
        ids, _ = self._by_library(self.bare, texts)
        ends = np.flatnonzero(ids == self.mark)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _pieces(self, units: pa.Array) -> pa.LargeListArray:
        """Ids of each piece."""
        words = units.to_pylist()
        if len(self.known) > self.kept:
            self._forget()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        plain = pc.match_substring_regex(units, _PLAIN[self.kind, self.lowers]).to_numpy(zero_copy_only=False)
        for encode, new in ((self._plain, np.flatnonzero((at < 0) & plain)), (partial(self._by_library, self.tokenizer), np.flatnonzero((at < 0) & ~plain))):
            fresh = [words[k] for k in new.tolist()]
            ids, n = encode(fresh)
            at[new] = np.arange(len(self.known), len(self.known) + len(fresh))
            self.known.update(zip(fresh, at[new].tolist()))
            self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
        ids, starts = _take(pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.ids)), at)
        return pa.LargeListArray.from_arrays(pa.array(starts), pa.array(ids))

    def _stretches(self, units: pa.Array) -> pa.LargeListArray:
        """Ids of each distinct stretch, by its pieces."""
        if self.lowers:
            units = pc.if_else(pc.string_is_ascii(units), pc.ascii_lower(units), units)  # others are composed first
        if not pc.any(pc.match_substring(units, _MARK)).as_py():
            units = pc.replace_substring_regex(units, r"(\pL)([.,;:!?])", rf"\1{_MARK}\2")
            if self.kind == "led":
                units = pc.replace_substring_regex(units, rf"([^{_SPACE}])\n([^{_SPACE}])", f"\\1{_MARK}\n{_MARK}\\2")
            lists = pc.split_pattern(units, _MARK)
        else:
            lists = pa.LargeListArray.from_arrays(pa.array(np.arange(len(units) + 1)), units)
        codes, distinct = _number(lists.values)
        ids, starts = _take(self._pieces(distinct), codes)
        return pa.LargeListArray.from_arrays(pa.array(starts[lists.offsets.to_numpy()]), pa.array(ids))

    def encode(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts): ids[starts[i]:starts[i+1]] are those of text i; null texts have none."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.kind == "whole":
            ids, n = self._by_library(self.tokenizer, texts.to_pylist())
            return ids, np.r_[0, np.cumsum(n)]
        lists = pc.split_pattern(texts, " ") if self.kind == "led" else pc.ascii_split_whitespace(texts)
        starts = lists.offsets.to_numpy().astype(np.int64)
        codes, words = _number(lists.values.slice(starts[0], starts[-1] - starts[0]))
        starts -= starts[0]
        if self.kind == "led":
            codes, starts, words = self._led(texts, codes, starts, words)
        ids, begin = _take(self._stretches(words), codes)
        return ids, begin[starts]

    @staticmethod
    def _led(texts: pa.Array, codes: np.ndarray, starts: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """A text's first stretch as it is, others with their blank; texts with longer white space are cut anew."""
        if not len(texts):
            return codes, starts, words
        odd = pc.match_substring_regex(words, rf"^$|^[{_SPACE}]|[{_SPACE}]$").to_numpy(zero_copy_only=False)
        first, bare = _number(words.take(pa.array(codes[starts[:-1]])))  # each text has one stretch at least, perhaps an empty one
        units = [pc.binary_join_element_wise(pa.scalar("", words.type), words, pa.scalar(" ", words.type)), bare]
        number = codes.astype(np.int64)
        number[starts[:-1]] = len(words) + first
        again = np.flatnonzero(np.add.reduceat(odd[codes].astype(np.int64), starts[:-1]))
        if len(again):
            base, seen = len(words) + len(bare), {}
            parts, at, sizes = [], 0, np.diff(starts)
            for k in again.tolist():
                parts.append(number[starts[at] : starts[k]])
                text = texts[k].as_py()
                cut = _BLANK.split(text) if text else []
                parts.append(np.array([base + seen.setdefault(u, len(seen)) for u in [*cut[:1], *(" " + u for u in cut[1:])]], np.int64))
                sizes[k] = len(cut)
                at = k + 1
            number = np.concatenate([*parts, number[starts[at] :]])
            starts = np.r_[0, np.cumsum(sizes)]
            units.append(pa.array(list(seen), words.type))
        return number, starts, pa.concat_arrays(units)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each process and file, with what it has learnt."""
    return Encoder(path)

"""Texts to token ids by a public tokenizer's own code, encoding each distinct piece of a text once.

Texts are cut before each lone space, and these stretches are numbered natively, a column at a time. Distinct
stretches fall into pieces at places where the tokenizers here can't but cut; pieces seen before are looked up.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import kept_by_tasks, release_memory

#: A lone space between two characters that aren't white space. In byte-level and word-end BPE alike no
#: token, and nothing that decides on a token, reaches across the left side of such a space.
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: What Python calls white space, for a native search: a text with two in a row, or with a space at an end, is cut by _LONE_SPACE.
_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ODD = rf"^ | $|{_WHITE}{_WHITE}"
#: Both tokenizers end a run of letters before these signs, and a lone line end before a letter: of a run of white space
#: the last character stands apart there, so the run mustn't be cut off. Natively a mark goes in between.
_CUT = re.compile(r"(?<=[A-Za-z])(?=[.,;:!?\n])|(?<=\S\n)(?=[A-Za-z])")
_MARK = "\x1f"
_MARKED = [(_WHITE.replace("[", "([^", 1) + r")\n([A-Za-z])", f"\\1\n{_MARK}\\2"), (r"([A-Za-z])([.,;:!?\n])", rf"\1{_MARK}\2")]
#: Pieces that are encoded as one text, characters of a piece that is kept, stretches whose ids are gathered at once.
_TOGETHER, _LONG, _GATHER = 64, 64, 1 << 17
#: Pieces that are Python strings at once (some 200 bytes each with its ids), and kept ones that are looked through at once (some 60 in a hash table).
_STRINGS, _TABLE = 1 << 14, 1 << 17
#: Bytes of texts that are encoded at once.
GROUP_BYTES = 6 << 20


def _gathered(store: np.ndarray, starts: np.ndarray, lengths: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Runs of store, each given by its number among the starts and lengths."""
    out, end = np.empty(int(lengths[place].sum()), store.dtype), 0
    for k in range(0, len(place), _GATHER):
        p = place[k : k + _GATHER]
        m = lengths[p]
        n = int(m.sum())
        out[end : end + n] = store[np.repeat(starts[p] - (np.cumsum(m) - m), m) + np.arange(n)]
        end += n
    return out


@dataclass
class Stretches:
    """Texts cut before each lone space, which is dropped. A text that isn't empty has one stretch at least."""

    rows: np.ndarray  #: numbers of the texts that aren't empty, ascending
    sizes: np.ndarray  #: how many stretches each of those has
    place: np.ndarray  #: of all stretches, in order, the number among the distinct ones
    words: pa.Array  #: the distinct ones

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def stretches(texts: pa.Array) -> Stretches:
    """The stretches of a large_string column without nulls, natively but for texts with other white space than lone spaces."""
    full = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) & full
    rows = np.concatenate([np.flatnonzero(full & ~odd), np.flatnonzero(odd)])
    lists = [pc.split_pattern(texts.filter(pa.array(full & ~odd)), " ")]
    if odd.any():
        lists.append(pa.array([_LONE_SPACE.split(t) for t in texts.filter(pa.array(odd)).to_pylist()], lists[0].type))
    sizes = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
    coded = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode()
    place = coded.indices.to_numpy()
    if odd.any():  # in the order of the texts
        order, starts = np.argsort(rows, kind="stable"), np.cumsum(sizes) - sizes
        sizes, starts, rows = sizes[order], starts[order], rows[order]
        place = place[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    return Stretches(rows, sizes, place, coded.dictionary)


class Encoder:
    """Gives the ids of whole texts, as Tokenizer.encode(text, add_special_tokens=False) would.

    cache_items: pieces that are kept, some 40 bytes each; once there are more, only those of the latest texts stay.
    plain_specials: strings of special tokens in a text are ordinary text; else each is its token, as is the library's default.
    """

    def __init__(self, path: str, cache_items: int = 500_000, *, plain_specials: bool = False) -> None:
        # A task has one core; the library's threads, one a core of the machine, keep some 40 MB in each Python worker.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {} if plain_specials else {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"{path} has added tokens that aren't plain strings of the raw text")
        self.specials = added
        self.at_specials = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})") if added else None
        # Texts are cut at special tokens before they come to it; what lower-casing makes of other signs is ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.cache_items = cache_items
        self.known = pa.array([], pa.large_string())
        self.store, self.starts, self.lengths = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)
        # A tokenizer that lower-cases all reads A-Z as a-z: then fewer stretches are distinct.
        self.folds = '"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str()).get("normalizer"))
        # Where pieces that are encoded together begin or end.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = bool(suffix)
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.endswith(suffix) if suffix else token.startswith("Ġ")
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else -1

    def _native(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def _together(self, pieces: list[str], between: str) -> np.ndarray:
        """Ids of pieces that are encoded _TOGETHER as one text; not all at once, as an encoding is a hundred times larger than its ids."""
        out = []
        for at in range(0, len(pieces), 64 * _TOGETHER):
            some = pieces[at : at + 64 * _TOGETHER]
            got = self.tokenizer.encode_batch_fast([between.join(some[k : k + _TOGETHER]) + between for k in range(0, len(some), _TOGETHER)], add_special_tokens=False)
            out.append(np.fromiter(itertools.chain.from_iterable(x.ids for x in got), "<u4"))
        return np.concatenate(out) if out else np.empty(0, "<u4")

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of pieces that are a space and letters each: so many tokens begin with the space, or end the word."""
        ids = self._together(words, "")
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):
            return self._native(words)
        cuts = [0, *(at + 1).tolist()] if self.ends else [*at.tolist(), len(ids)]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in itertools.pairwise(cuts)]

    def _lines(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space but for a space before them, which stand in a line each."""
        if self.line < 0:
            return self._native(pieces)
        ids = self._together(pieces, "\n")
        at = np.flatnonzero(ids == self.line).tolist()
        if len(at) != len(pieces):
            return self._native(pieces)
        raw = ids.tobytes()
        return [raw[4 * a + 4 : 4 * b] for a, b in itertools.pairwise([-1, *at])]

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        kinds: tuple[list, list, list] = ([], [], [])
        for i, p in enumerate(pieces):
            own = p[1:] if p[:1] == " " else p
            kinds[0 if own.isalpha() and (own is not p or self.ends) and len(p) <= _LONG else 1 if p and len(own.split()) == 1 and own.strip() == own else 2].append(i)
        out = [b""] * len(pieces)
        for some, encode in zip(kinds, (lambda x: self._words([p if p[0] == " " else f" {p}" for p in x]), self._lines, self._native)):
            for i, ids in zip(some, encode([pieces[i] for i in some])):
                out[i] = ids
        return out

    def _looked_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A store of ids, and where in it those of distinct pieces start and how many there are."""
        place = np.full(len(pieces), -1, np.int64)
        for at in range(0, len(self.known), _TABLE):
            found = pc.fill_null(pc.index_in(pieces, value_set=self.known.slice(at, _TABLE)), -1).to_numpy()
            place = np.where(found < 0, place, found + at)
        new = place < 0
        missing = pieces.filter(pa.array(new))
        parts, lengths = [self.store], np.empty(len(missing), np.int64)
        for at in range(0, len(missing), _STRINGS):
            ids = self._encoded(missing.slice(at, _STRINGS).to_pylist())
            lengths[at : at + len(ids)] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            parts.append(np.frombuffer(b"".join(ids), "<u4"))
        store = np.concatenate(parts)
        starts = np.concatenate([self.starts, len(self.store) + np.cumsum(lengths) - lengths])
        lengths = np.concatenate([self.lengths, lengths])
        place[new] = len(self.known) + np.arange(len(missing))
        short = pc.less_equal(pc.utf8_length(missing), _LONG).to_numpy(zero_copy_only=False)
        if len(self.known) + len(missing) <= self.cache_items and short.all():
            self.known = pa.concat_arrays([self.known, missing])
            self.store, self.starts, self.lengths = store, starts, lengths
        else:
            kept = pc.less_equal(pc.utf8_length(pieces), _LONG).to_numpy(zero_copy_only=False)
            if len(self.known) + len(missing) <= self.cache_items:  # all but the long ones
                kept = np.concatenate([np.arange(len(self.known)), len(self.known) + np.flatnonzero(short)])
                names = pa.concat_arrays([self.known, missing.filter(pa.array(short))])
            else:
                names, kept = pieces.filter(pa.array(kept)), place[kept]
            self.known, self.lengths = names, lengths[kept]
            self.store = _gathered(store, starts, lengths, kept)
            self.starts = np.cumsum(self.lengths) - self.lengths
        return store, starts[place], lengths[place]

    def _coded(self, distinct: pa.Array, ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids of distinct stretches one after another, with the space before those that have one, and the number of each one's."""
        if pc.any(pc.match_substring(distinct, _MARK)).as_py():
            split = pa.array([_CUT.split(s) for s in distinct.to_pylist()], pa.large_list(pa.large_string()))
        else:
            for pattern, by in _MARKED:
                distinct = pc.replace_substring_regex(distinct, pattern, by)
            split = pc.split_pattern(distinct, _MARK)
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        store, begin, lengths = self._looked_up(coded.dictionary)
        place = coded.indices.to_numpy()
        counts = np.add.reduceat(lengths[place], np.cumsum(sizes) - sizes)
        return _gathered(store, begin, lengths, place) if ids else None, counts

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of each text's; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = pc.match_substring_regex(texts, self.at_specials.pattern).to_numpy(zero_copy_only=False) if self.specials else np.zeros(len(texts), bool)
        if not marked.any():
            return self._encode_plain(texts)
        # Stretches between special tokens are texts of their own; the tokens, at odd places, are put in after them.
        split = [self.at_specials.split(t.as_py()) if m else [t.as_py()] for t, m in zip(texts, marked.tolist())]
        ids, counts = self._encode_plain(pa.array([p for parts in split for p in parts[::2]], pa.large_string()))
        stretches = np.array([(len(parts) + 1) // 2 for parts in split])
        inner = np.ones(len(counts), bool)  # stretches that a special token follows
        inner[np.cumsum(stretches) - 1] = False
        own = np.array([self.specials[p] for parts in split for p in parts[1::2]], "<u4")
        whole = np.insert(ids, np.cumsum(counts)[inner], own)
        return whole, np.add.reduceat(counts, np.cumsum(stretches) - stretches) + stretches - 1

    def _coded_texts(self, texts: pa.Array, ids: bool) -> tuple[Stretches, np.ndarray, np.ndarray | None, np.ndarray]:
        """The stretches of texts; of each its number, and the ids of all (None if only counts are asked for) with their counts."""
        found = stretches(pc.ascii_lower(texts) if self.folds else texts)
        # The first stretch of a text has no space before it: those are numbered after the others.
        place, starts = found.place.copy(), found.starts
        heads, inverse = np.unique(place[starts], return_inverse=True)
        place[starts] = len(found.words) + inverse
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), found.words, pa.scalar(" ", pa.large_string()))
        return found, place, *self._coded(pa.concat_arrays([spaced, found.words.take(pa.array(heads))]), ids)

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(texts), np.int64)
        if not pc.any(pc.not_equal(texts, "")).as_py():
            return np.empty(0, "<u4"), counts
        found, place, store, lengths = self._coded_texts(texts, True)
        counts[found.rows] = np.add.reduceat(lengths[place], found.starts)
        return _gathered(store, np.cumsum(lengths) - lengths, lengths, place), counts

    def count_column(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text, without putting the ids together; 0 for a null text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.specials and pc.any(pc.match_substring_regex(texts, self.at_specials.pattern)).as_py():
            return self.encode_column(texts)[1]
        counts = np.zeros(len(texts), np.int64)
        if pc.any(pc.not_equal(texts, "")).as_py():
            found, place, _, lengths = self._coded_texts(texts, False)
            counts[found.rows] = np.add.reduceat(lengths[place], found.starts)
        return counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text has none."""
        ids, counts = self.encode_column(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []


@functools.lru_cache(maxsize=1)
def encoder(path: str, *, plain_specials: bool = False) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, plain_specials=plain_specials)


kept_by_tasks.append(encoder.cache_clear)


def grouped(batches: Iterator[pa.RecordBatch], column: int, most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in larger batches, of most bytes of a text column or one batch more: the more texts, the fewer of their stretches are distinct."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(column).nbytes
            if size >= most:
                whole, held, size = joined(), [], 0
                yield whole
                del whole
                release_memory()
    if held:
        yield joined()
        held = []
    release_memory()

"""Operator 7, BPE encoding and decoding by a walk over a trie of distinct words.

Merging is prefix-consistent: if a word's tokens are known, so are those of any prefix
that ends at a token's end, and a prefix's encoding is told by its last token and the
prefix before that. So a node of the trie needs one thing only, the last token of its
prefix. It is the token that ends there and may stand behind the last token of the
node where it starts; "may stand" is decided by the merges across the border. The
distinct words of a run of texts are walked in sorted order, which is the depth-first
order of their trie: the stack holds the nodes of the current word, and what a word
shares with the one before it is not computed again.

Around the walk a run of texts is worked on as arrays: its texts are put into lower
case, cut at white space and made a dictionary, so Python meets each distinct word of a
run once, and ids and strings of tokens are gathered by numpy and Arrow.

Defined results: a null or empty text has no tokens; an empty table gives an empty
table. The strings of added tokens in a text become those tokens, as in the library.
Rows are kept one by one, repeats and null keys too. Texts of any length are encoded
whole: long ones in segments that end at white space, which no rule looks across, so
memory is bounded by a run and, where ids or decoded texts are asked for, by the longest
of these. Only key and text are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.shared import read, text_of
from tessera.llm.words import U64, hashes, spans

#: Bytes of known words that a Python worker keeps between runs.
CACHE_BYTES = 40 << 20
#: Pairs of tokens whose fit is known, at most.
FITS = 1 << 17
#: Texts are encoded in runs of about so many characters.
RUN_CHARS = 2 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and text rules of a tokenizer file with word-end marks."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.mark: str = model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in self.ids.items()}
        self.merged: dict[tuple[int, int], int] = {}  # pair of ids: rank
        self.made: dict[int, tuple[int, int, int]] = {}  # id: rank, left, right
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = self.ids[a], self.ids[b], self.ids[a.removesuffix(self.mark) + b if self.mark and a.endswith(self.mark) else a + b]
            self.merged[left, right] = rank
            self.made.setdefault(whole, (rank, left, right))
        #: Tokens within words, and those that end words, without their mark.
        self.inner = {t: i for t, i in self.ids.items() if not (self.mark and t.endswith(self.mark) and len(t) > len(self.mark))}
        self.final = {t.removesuffix(self.mark): i for t, i in self.ids.items() if t not in self.inner} if self.mark else self.inner
        self.final_ends = _ends(self.final)
        self.inside = ahocorasick.Automaton(ahocorasick.STORE_INTS)  # finds all tokens that end at a place, the longest first
        for t, i in self.inner.items():
            self.inside.add_word(t, i << _LENGTH_BITS | len(t))
        self.inside.make_automaton()
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.names |= {i: t for t, i in self.added.items()}
        self.added_re = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        self.added_start = os.path.commonprefix([*self.added])  # a quick test before the search
        # The library's \s is Unicode's White_Space; Python's also has U+001C to U+001F.
        self.word_re = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.fits: dict[int, bool] = {}

    def fit(self, left: int, right: int) -> bool:
        """may_follow(), remembered."""
        pair = left << 20 | right
        if (found := self.fits.get(pair)) is None:
            if len(self.fits) >= FITS:
                self.fits.clear()
            found = self.fits[pair] = self.may_follow(left, right)
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens leaves just these two.

        Undo the later of the two tokens' merges, again and again, and look at the pairs
        that met at the border on the way: had one of them a merge of lower rank than what
        took its sides away, merging would have crossed the border.
        """
        merged, made = self.merged, self.made
        until = 1 << 60  # pairs at the border stand there until the merge of this rank
        first = True
        while True:
            rank = merged.get((left, right))
            # On equal rank the leftmost pair merges first, so a border pair behind the undone left merge comes too late.
            if rank is not None and (rank < until or (rank == until and first)):
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                until, first, left = a[0], False, a[2]
            else:
                until, first, right = b[0], True, b[1]

    def normal(self, text: str) -> str:
        """A text in lower case, with the marks of added tokens for these. What stands between white space is a chunk."""
        if self.added_start in text and self.added_re.search(text):
            parts = self.added_re.split(text)
            names = self.added_re.findall(text)
            return "".join([x for part, name in zip(parts, [*names, None], strict=True) for x in (_lower(part), f" {_ADDED}{self.added[name]} " if name else "")])
        return _lower(text)

    def words(self, chunk: str) -> list[str | int]:
        """Words of a chunk, one letter per byte still to come; or the id that it marks."""
        if chunk.startswith(_ADDED):
            return [int(chunk[1:])]
        return [chunk] if chunk.isalpha() else self.word_re.findall(chunk)


#: A capital letter begins the marks of added tokens: there is none in a text in lower case.
_ADDED = "T"
_LENGTH_BITS = 12


def _lower(text: str) -> str:
    """The library puts letter by letter into lower case, so a final sigma is like any other."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join([c.lower() for c in text])


class Walk:
    """Encodes sorted words; the nodes of the current word's path are on a stack."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.path = ""
        self.last: list[int] = [0]  # last token of each prefix of path
        self.size: list[int] = [0]  # and its length

    def encode(self, word: str) -> list[int]:
        v, inner, shared = self.v, len(word) - 1, 0
        last, size, fit = self.last, self.size, self.v.fit
        for a, b in zip(self.path, word[:inner], strict=False):
            if a != b:
                break
            shared += 1
        del last[shared + 1 :], size[shared + 1 :]
        done, length = shared, (1 << _LENGTH_BITS) - 1
        if done < inner:
            for end, token in v.inside.iter(word, 0, inner):
                if end < done:
                    continue
                n = token & length
                if n > end or fit(last[end + 1 - n], token >> _LENGTH_BITS):
                    last.append(token >> _LENGTH_BITS)
                    size.append(n)
                    done = end + 1
        self.path = word[:inner]
        # The last letter carries the mark of a word's end.
        for n in v.final_ends.get(word[-3:], _SHORT):
            if n <= inner + 1 and (token := v.final.get(word[inner + 1 - n :])) is not None and (n > inner or fit(last[inner + 1 - n], token)):
                break
        else:
            raise ValueError(f"{word!r} has a letter outside the vocabulary")
        if len(last) != inner + 1:
            raise ValueError(f"{word!r} has a letter outside the vocabulary")
        out = [token]
        at = inner + 1 - n
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]


#: Lengths of the tokens that may end anywhere.
_SHORT = (2, 1)


def _ends(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """For three letters, the lengths that tokens with this end have, longest first."""
    found: dict[str, set[int]] = {}
    for token in tokens:
        if len(token) > 2:
            found.setdefault(token[-3:], set()).add(len(token))
    return {k: (*sorted(v, reverse=True), *_SHORT) for k, v in found.items()}


def encode_words(vocabulary: Vocabulary, words: Iterable[str]) -> dict[str, list[int]]:
    """Token ids of distinct words (byte letters not yet put in)."""
    letters = vocabulary.letters
    spelled = {}
    for word in words:
        spelled[word if word.isascii() and word.isprintable() else "".join([letters[b] for b in word.encode()])] = word
    walk = Walk(vocabulary)
    return {spelled[x]: walk.encode(x) for x in sorted(spelled)}


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def _encoder(path: str) -> Encoder:
    """One for a Python worker: the next task finds its words known."""
    return Encoder(vocabulary(path))


class Known:
    """Strings by 128 bits of hash and their ids, as arrays; what was not used for long goes when CACHE_BYTES are full."""

    def __init__(self) -> None:
        self.a, self.b = np.empty(0, U64), np.empty(0, U64)  # sorted by a
        self.begin, self.size, self.used, self.pool = (np.empty(0, np.int32) for _ in range(4))
        self.turn = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.a):
            return np.full(len(keys), -1)
        last = len(self.a) - 1
        at = np.searchsorted(self.a, keys[:, 0])
        while True:  # ends at once but for keys that have their first half in common
            here = np.minimum(at, last)
            same = (at <= last) & (self.a[here] == keys[:, 0])
            whole = same & (self.b[here] == keys[:, 1])
            if (same == whole).all():
                return np.where(whole, at, -1)
            at = at + (same & ~whole)

    def add(self, keys: np.ndarray, lists: list[list[int]]) -> None:
        order = np.argsort(keys[:, 0], kind="stable")
        size = np.fromiter(map(len, lists), np.int32, len(lists))
        begin = len(self.pool) + np.cumsum(size, dtype=np.int32) - size
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(lists), np.int32)])
        at = np.searchsorted(self.a, keys[order, 0])
        for name, values in (("a", keys[:, 0]), ("b", keys[:, 1]), ("begin", begin), ("size", size), ("used", np.full(len(size), self.turn, np.int32))):
            setattr(self, name, np.insert(getattr(self, name), at, values[order]))

    def trim(self) -> None:
        """Begins a run; leaves the half used last of what is too much."""
        self.turn += 1
        if 28 * len(self.a) + self.pool.nbytes > CACHE_BYTES:
            keep = self.used > np.median(self.used)
            self.a, self.b, self.size, self.used, begin = self.a[keep], self.b[keep], self.size[keep], self.used[keep], self.begin[keep]
            self.pool = _stretches(self.pool, begin, self.size)[0]
            self.begin = np.cumsum(self.size, dtype=np.int32) - self.size


def _stretches(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of an array behind each other, and where each begins, with the end of the last."""
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    return values[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], ends


def _keys(strings: pa.Array) -> np.ndarray:
    data, at = spans(strings)
    return np.stack([hashes(data, at[:-1], at[1:]), hashes(data ^ np.uint8(0xA5), at[:-1], at[1:])], 1)


class Encoder:
    """Token ids of runs of texts. A Python worker has one, whose known chunks and words last from task to task."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.known = v, Known()
        top = max(v.names) + 1
        self.decimal = pa.array([str(i) for i in range(top)], pa.large_string())
        self.named = pa.array([v.names.get(i, "") for i in range(top)], pa.large_string())

    def learn(self, chunks: pa.Array) -> np.ndarray:
        """Makes distinct chunks known, and gives their places."""
        known, keys = self.known, _keys(chunks)
        known.trim()
        new = np.flatnonzero(known.find(keys) < 0)
        if len(new):
            names = chunks.take(pa.array(new)).to_pylist()
            cut = [self.v.words(x) for x in names]
            words = sorted({w for parts in cut for w in parts if isinstance(w, str)})
            word_keys = _keys(pa.array(words, pa.large_string()))
            at = known.find(word_keys)
            ids_of = encode_words(self.v, [words[i] for i in np.flatnonzero(at < 0)])
            names = set(names)
            fresh = [i for i in np.flatnonzero(at < 0).tolist() if words[i] not in names]
            there = np.flatnonzero(at >= 0)
            ids, ends = _stretches(known.pool, known.begin[at[there]], known.size[at[there]])
            ids = ids.tolist()
            ids_of |= {words[i]: ids[a:b] for i, a, b in zip(there.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
            lists = [ids_of[parts[0]] if len(parts) == 1 and isinstance(parts[0], str) else [t for w in parts for t in (ids_of[w] if isinstance(w, str) else (w,))] for parts in cut]
            known.add(np.concatenate([keys[new], word_keys[fresh]]), lists + [ids_of[words[i]] for i in fresh])
        at = known.find(keys)
        known.used[at] = known.turn
        return at

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin, with the end of the last."""
        lists = pc.ascii_split_whitespace(pa.array([self.v.normal(x) for x in texts], pa.large_string()))
        chunks = lists.flatten().dictionary_encode()
        at = self.learn(chunks.dictionary)[chunks.indices.to_numpy()]
        out, ends = _stretches(self.known.pool, self.known.begin[at], self.known.size[at])
        return out, ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]

    def _joined(self, names: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(at.astype(np.int32), names.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))

    def decimals(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The ids of each text in decimal, joined by spaces."""
        return self._joined(self.decimal, ids, at)

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The names of each text's ids: this kind of file has no decoder, so the library joins tokens by spaces."""
        return self._joined(self.named, ids, at)

    def run(self, texts: list[str]) -> list[str]:
        return self.decimals(*self.ids(texts)).to_pylist()

    def decode(self, ids: str) -> str:
        numbers = np.array(ids.split(), np.int32)
        return self.decoded(numbers, np.array([0, len(numbers)]))[0].as_py()


_SPACE = regex.compile(r"[ \t-\r]")


def segments(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and texts, about RUN_CHARS at a time; a longer text comes in parts that end before white space."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        text, begin = text or "", 0
        while True:
            found = _SPACE.search(text, begin + RUN_CHARS) if len(text) - begin > RUN_CHARS else None
            end = found.start() if found else len(text)
            rows.append(row)
            parts.append(text[begin:end])
            size += end - begin
            if size >= RUN_CHARS:
                yield rows, parts
                rows, parts, size = [], [], 0
            begin = end
            if end == len(text):
                break
    if rows:
        yield rows, parts


class _Digest:
    """SHA-256 of strings joined by spaces, of which the empty ones count for nothing."""

    def __init__(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def add(self, part: pa.Scalar) -> None:
        data = part.as_buffer()
        if data.size:
            if self.any:
                self.sha.update(b" ")
            self.sha.update(data)
            self.any = True


EXTRA = {"ids": "array<int>", "decoded": "string"}


def encoded(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = tuple(EXTRA)) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and what `extra` names: ids and decoded.

    path: the tokenizer file, which every executor must have in the same place. A task
    encodes the distinct words of its own texts; no shuffle.
    """
    kinds = {"ids": pa.list_(pa.int32()), "decoded": pa.string()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for whole in batches:
            for batch in _runs(whole):
                n = batch.num_rows
                counts, digests, told = np.zeros(n, np.int64), [_Digest() for _ in range(n)], [_Digest() for _ in range(n)]
                kept: list[list[np.ndarray]] = [[] for _ in range(n)]
                names: list[list[str]] = [[] for _ in range(n)]
                for rows, parts in segments(batch.column(1).to_pylist()):
                    ids, at = encoder.ids(parts)
                    for row, one, two, begin, end in zip(rows, encoder.decimals(ids, at), encoder.decoded(ids, at), at[:-1].tolist(), at[1:].tolist(), strict=True):
                        counts[row] += end - begin
                        digests[row].add(one)
                        told[row].add(two)
                        if "ids" in extra:
                            kept[row].append(ids[begin:end])
                        if "decoded" in extra and end > begin:
                            names[row].append(two.as_py())
                more = {"ids": [np.concatenate(x) for x in kept] if "ids" in extra else [], "decoded": [" ".join(x) for x in names]}
                yield pa.record_batch(
                    [batch.column(0), pa.array(counts), pa.array([x.sha.hexdigest() for x in digests], pa.string()), pa.array([x.sha.hexdigest() for x in told], pa.string()), *(pa.array(more[x], kinds[x]) for x in extra)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *extra],
                )

    return text_of(df, key, text).mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {x} {EXTRA[x]}" for x in extra))


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with about RUN_CHARS bytes of text at a time."""
    begin = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()):
        size += n or 0
        if size >= RUN_CHARS:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"), default_path(), extra=())

"""Operator 9: BPE encoding and decoding by a tokenization automaton.

The vocabulary's merges are compiled one after another. Before any merge there is one state, with an arc for each byte
that leads back to it. The gadget of merge (u, v) -> x takes the state t that arcs labelled u lead to; if t has an arc v
to r, arcs u are led to a copy of t without that arc v, and every state with an arc u gets an arc x to r. All arcs with
one label lead to one state, so a row of the transition table need only tell which arcs its state has. Labels are
numbered so that what a cut takes from a state (the label, and those that grow from it later) are ranges: a row is a
sorted list of the ranges that its state lacks, and all rows are one numpy array.

BPE gives each prefix of a word one path. So a word is encoded from left to right without going back: of the labels
that end at a position, one is an arc of the state where it starts, and its end gets the state that the table names. Many
words take these transitions together, in numpy; the labels are read back from the words' ends. Decoding emits the
labels' bytes.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch, pick, slices, table

#: Fixed value: the pre-splitting pattern of byte-level BPE vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a vocabulary file must say for its texts to be encoded by merges of bytes alone.
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: The same pattern with its classes written out for texts in Latin-1, on which it is faster.
LATIN_WORDS = WORDS.replace(r"[^\s\p{L}\p{N}]", "[^{s}{l}{n}]").replace(r"\p{L}", "[{l}]").replace(r"\p{N}", "[{n}]").replace(r"\s", "[{s}]").replace(r"\S", "[^{s}]")
for _k, _v in {"{l}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "{n}": "0-9\xb2\xb3\xb9\xbc-\xbe", "{s}": "\t-\r \x85\xa0"}.items():
    LATIN_WORDS = LATIN_WORDS.replace(_k, _v)
#: Bytes of words and ids that a worker remembers, about.
MEMO_BYTES = 40 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def refuse(path: str, spec: dict) -> None:
    """Raises for a vocabulary that plain merges of bytes don't encode as its library does."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k, v in PLAIN_MODEL.items() if (model.get(k) or None) != (v or None)]
    odd += [f"pre_tokenizer.{k}" for k, v in PLAIN_SPLIT.items() if split.get(k, True) != v]
    odd += ["normalizer"] if spec.get("normalizer") else []
    odd += [f"added token {x['content']}" for x in spec.get("added_tokens", []) if x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]]
    if odd:
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary: {', '.join(odd)}")


class TokenAutomaton:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse(path, spec)
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        if len({x for _, _, x in merges}) < len(merges) or any(c not in vocab for c in letters):
            raise ValueError(f"{path}: two merges make one token, or a byte has none")
        spelled = {i: spell(s) for s, i in vocab.items() if s not in special}
        self.special = {s: np.int32(i).tobytes() for s, i in special.items()}
        #: the bytes of each id, for decoding
        every = spelled | {i: s.encode() for s, i in special.items()}
        self.labels = pa.array([every.get(i, b"") for i in range(max(every) + 1)], pa.binary())
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words, self.latin_words = regex.compile(WORDS), re.compile(LATIN_WORDS)
        self.known: dict[str, bytes] = dict(self.special)
        self.known_bytes = 0
        self._number(merges, [vocab[c] for c in letters], len(self.labels))
        self._merge(merges, [vocab[c] for c in letters])
        self._rows()
        self._spell(spelled)

    def _number(self, merges: list[tuple[int, int, int]], single: list[int], size: int) -> None:
        """Numbers labels in the order of a walk from a label to those that it is the first part of, in the order of their
        merges. `place` is a label's number, `stop` the number after the last one that grows from it."""
        self.grows: dict[int, list[tuple[int, int]]] = {}
        for time, (u, _, x) in enumerate(merges):
            self.grows.setdefault(u, []).append((time, x))
        self.place, self.stop = [0] * size, [0] * size
        at, open_ = 0, [(b, False) for b in reversed(single)]
        while open_:
            label, done = open_.pop()
            if done:
                self.stop[label] = at
                continue
            self.place[label] = at
            at += 1
            open_.append((label, True))
            open_ += [(x, False) for _, x in reversed(self.grows.get(label, ()))]

    def _merge(self, merges: list[tuple[int, int, int]], single: list[int]) -> None:
        """The gadgets, one after another. A copied state is kept as its parent and the arc that it lacks: label and time."""
        self.parent, self.lacks = [-1], [(-1, -1)]
        self.leads_to = dict.fromkeys(single, 0)
        first: dict[int, int] = {}
        last: dict[int, int] = {}
        made: dict[int, int] = {}
        cuts: dict[tuple[int, int], int] = {}

        def has(u: int, v: int) -> bool:
            """Whether the state after u still has the arc v. It came from the state after u's last part when u was made, and
            arc v from the arc of its first part when v was made: older cuts were taken over, younger ones weren't."""
            until = len(merges)
            while True:
                y, limit = v, len(merges)
                while True:
                    time = cuts.get((u, y))
                    if time is not None and time < until and time <= limit:
                        return False
                    if y not in first:
                        break
                    limit, y = made[y], first[y]
                if u not in last:
                    return True
                until, u = made[u], last[u]

        for time, (u, v, x) in enumerate(merges):
            if u not in self.leads_to or v not in self.leads_to or not has(u, v):
                continue  # no path has u before v: the merge is never used
            self.parent.append(self.leads_to[u])
            self.lacks.append((v, time))
            self.leads_to[x] = self.leads_to[v]
            self.leads_to[u] = len(self.parent) - 1
            cuts[u, v] = time
            first[x], last[x], made[x] = u, v, time
    def _rows(self) -> None:
        """The table: for each state that an arc leads to, the sorted ranges of places whose arcs it lacks. All rows are one
        array of state << 32 | end of a range, so that many arcs are looked up at once."""
        parent = np.array(self.parent)
        label = np.array([y for y, _ in self.lacks])
        place, stop = np.array(self.place), np.array(self.stop)
        # what grew from the label after the cut is gone, too
        later = np.array([self.place[g[k][1]] if (k := bisect_right(g := self.grows.get(y, []), (t, -1))) < len(g) else self.stop[y] for y, t in self.lacks])
        low, high = place[label], stop[label]
        cuts: dict[int, np.ndarray] = {0: np.empty(0, np.int64)}
        rows: list[np.ndarray] = []
        states = sorted(set(self.leads_to.values()))
        self.row_start = np.zeros(len(parent), np.int64)
        at = 0
        for state in states:
            chain, s = [], state
            while s not in cuts:
                chain.append(s)
                s = int(parent[s])
            own = np.concatenate((cuts[s], np.array(chain, np.int64)))
            cuts[state] = own
            if len(own):
                lo, hi = np.concatenate((low[own], later[own])), np.concatenate((low[own] + 1, high[own]))
                order = np.argsort(lo, kind="stable")
                lo, reach = lo[order], np.maximum.accumulate(hi[order])
                begins = np.concatenate(([True], lo[1:] > reach[:-1]))
                ends = np.concatenate((begins[1:], [True]))
                row = np.stack((lo[begins], reach[ends]), axis=1).reshape(-1)
                rows.append(row + (state << 32))
                self.row_start[state] = at
                at += len(row)
        self.bounds = np.concatenate(rows)

    def _spell(self, spelled: dict[int, bytes]) -> None:
        """The trie of the spellings of labels that have an arc: sorted keys place << 8 | byte, and the place that each leads to."""
        trie: dict[int, int] = {}
        ends = [-1]
        for label in self.leads_to:
            node = 0
            for b in spelled[label]:
                key = node << 8 | b
                node = trie.get(key, 0)
                if not node:
                    node = trie[key] = len(ends)
                    ends.append(-1)
            ends[node] = label
        #: where the first two bytes lead, 0: nowhere
        self.twice = np.zeros((256, 256), np.int64)
        for key, node in trie.items():
            if key < 256:
                for b in range(256):
                    self.twice[key, b] = trie.get(node << 8 | b, 0)
        self.once = np.array([trie[b] for b in range(256)], np.int64)
        self.keys = np.array(sorted(trie), np.int64)
        self.nodes = np.array([trie[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)
        size = len(self.labels)
        self.place = np.array(self.place, np.int64)
        self.to = np.array([self.leads_to.get(i, -1) for i in range(size)], np.int64)
        self.length = np.array([len(spelled.get(i, b"")) for i in range(size)], np.int64)
        del self.grows, self.leads_to, self.parent, self.lacks, self.stop

    def has_arcs(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether each state has an arc of the label beside it: a look-up in the table."""
        before = np.searchsorted(self.bounds, (states << 32) + self.place[labels], side="right")
        return (before - self.row_start[states]) & 1 == 0

    def spelled_at(self, data: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, label) of each label that the bytes from a start on spell, within the start's word; last: its end."""
        at = np.arange(len(data))
        starts, labels = [at], [self.ends[self.once[data]]]
        at = at[at + 1 < last]
        node = self.twice[data[at], data[at + 1]]
        at, node, k = at[node > 0], node[node > 0], 2
        while len(at):
            label = self.ends[node]
            whole = label >= 0
            starts.append(at[whole])
            labels.append(label[whole])
            more = at + k < last[at]
            at, node = at[more], node[more]
            key = node << 8 | data[at + k]
            slot = np.searchsorted(self.keys, key)
            slot[slot == len(self.keys)] = 0
            there = self.keys[slot] == key
            at, node = at[there], self.nodes[slot[there]]
            k += 1
        return np.concatenate(starts), np.concatenate(labels)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """For each pre-split word its ids, as 32-bit integers in a row.

        Each end of a label in a word is reached by exactly one path, whose state is entered there: positions are filled from
        left to right, for all words together, by the one arc into each.
        """
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        word_end = np.repeat(begin + size, size)
        start, label = self.spelled_at(data, word_end)
        end = start + self.length[label]
        offset = end - np.repeat(begin, size)[start]
        order = np.argsort(offset, kind="stable")
        start, label, end = start[order], label[order], end[order]
        cuts = np.flatnonzero(np.diff(offset[order], prepend=0, append=0)) if len(order) else np.zeros(0, int)
        # state[i + 1] and into[i + 1]: the state before byte i + 1 of its word and the label that ends there
        state, into = np.zeros(len(data) + 1, np.int64), np.full(len(data) + 1, -1, np.int64)
        entry = np.zeros(len(data) + 1, bool)
        entry[begin] = True
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            s, x, e = start[lo:hi], label[lo:hi], end[lo:hi]
            before = np.where(entry[s], 0, state[s])
            ok = self.has_arcs(before, x)
            into[e[ok]], state[e[ok]] = x[ok], self.to[x[ok]]
        # each word's labels are read back from its end
        open_, at, read = np.arange(len(raw))[size > 0], (begin + size)[size > 0], []
        while len(open_):
            x = into[at]
            read.append((open_, x))
            at = at - self.length[x]
            more = at > begin[open_]
            open_, at = open_[more], at[more]
        count = np.bincount(np.concatenate([w for w, _ in read]), minlength=len(raw)) if read else np.zeros(len(raw), np.int64)
        stops = np.cumsum(count)
        ids = np.empty(int(stops[-1]) if len(raw) else 0, np.int32)
        for k, (w, x) in enumerate(read):
            ids[stops[w] - 1 - k] = x
        flat, stops = ids.tobytes(), (stops * 4).tolist()
        return [flat[lo:hi] for lo, hi in zip([0, *stops], stops)]

    def split(self, text: str) -> list[str]:
        """The pre-split words of a text without special strings."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words.findall(text)
        return self.latin_words.findall(text)

    def encode(self, texts: list[str | None]) -> pa.Array:
        """The ids of each text, as a list array. Words that weren't met lately are encoded together."""
        parts = [[] if not t else self.splitter.split(t) if self.splitter else [t] for t in texts]
        # an odd part is a special string
        split = [[self.split(x) if k % 2 == 0 else [x] for k, x in enumerate(own)] for own in parts]
        if self.known_bytes > MEMO_BYTES:
            self.known, self.known_bytes = dict(self.special), 0
        new = list({w for own in split for words in own for w in words}.difference(self.known))
        self.known.update(zip(new, self.encode_words(new)))
        self.known_bytes += sum(180 + 3 * len(w) for w in new)
        ids = [b"".join([b"".join(map(self.known.__getitem__, words)) for words in own]) for own in split]
        ends = np.cumsum([0, *map(len, ids)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))

    def decode(self, ids: pa.Array) -> pa.Array:
        """The texts of a list array of ids; null ids give an empty text."""
        lengths = pc.list_value_length(ids).fill_null(0)
        ends = pa.array(np.concatenate(([0], np.cumsum(lengths.to_numpy(zero_copy_only=False)))), pa.int32())
        raw = pc.binary_join(pa.ListArray.from_arrays(ends, self.labels.take(ids.flatten())), b"")
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that aren't UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


@lru_cache(maxsize=1)
def automaton(path: str) -> TokenAutomaton:
    return TokenAutomaton(path)


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row of docs, in one pass without a shuffle.

    A null text is an empty one and has no ids; special strings inside texts become their ids, as the vocabulary's
    library does by default; rows that repeat are encoded each; an empty table gives an empty one; only the id and text
    columns are read, so that others may have any names. Memory: a slice of about a megabyte of texts (or one text), the
    table (about 20 MB for 50,000 merges) and a memo of MEMO_BYTES. A vocabulary that isn't plain byte-level BPE, or in
    which two merges make one token, raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = automaton(vocabulary)
        for part in slices(batches, 1):
            yield batch(key=part.column(0), ids=tokens.encode(part.column(1).to_pylist()))

    slim = pick(docs, id_col, text_col)
    out = arrow_map(slim, run, f"key {kind_of(slim, id_col)}, ids array<int>")
    return out.select(F.col("key").alias(id_col), "ids")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text): the labels' bytes of each row's ids, as UTF-8 with U+FFFD for what isn't. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = automaton(vocabulary)
        for part in slices(batches, 1):
            yield batch(key=part.column(0), ids=part.column(1), text=tokens.decode(part.column(1)))

    slim = pick(encoded, id_col, ids_col)
    out = arrow_map(slim, run, f"key {kind_of(slim, id_col)}, ids array<int>, text string")
    return out.select(F.col("key").alias(id_col), F.col("ids").alias(ids_col), "text")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text): what decode(encode(docs)) gives, in one pass over the texts. Rows as in `encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = automaton(vocabulary)
        for part in slices(batches, 1):
            ids = tokens.encode(part.column(1).to_pylist())
            yield batch(key=part.column(0), ids=ids, text=tokens.decode(ids))

    slim = pick(docs, id_col, text_col)
    out = arrow_map(slim, run, f"key {kind_of(slim, id_col)}, ids array<int>, text string")
    return out.select(F.col("key").alias(id_col), "ids", "text")


def digests(decoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    import public_tokenizers

    return digests(round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs. A null text is an empty one; rows with null or
    repeated ids give a row each; other columns aren't read; an empty table gives an empty one."""
    import public_tokenizers

    return digests(round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")))

"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that BPE
produces.  It starts as one state with an arc to itself for each byte.  Every
merge (a, b) -> c then adds a gadget: the state p that the a-arcs lead to is
copied without its b-arc, the a-arcs are led to the copy, and each state with
an a-arc gets a c-arc to where a then b led before.  All arcs with one label
lead to one state, so a state is a chain of copies and each copy records its
parent, the label it lost and the merge that made it.

Of every prefix of a word the automaton accepts one path, so a word is read by
one deterministic step a byte.  Two tables drive it: the byte table leads from
the longest end of the prefix that begins a label to the next such end; the arc
table tells whether a label that ends there may follow the arc at the place
where it begins, which holds for just one label.  Entries are compiled from the
merges and the gadgets' records when they are first needed, and tabulated; all
of them together would not fit in memory.  A word's arcs are read off from its
end.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, hold, ship

#: Distinct chunks, and pre-split words, kept by a worker in each of two generations; what is used again passes to the younger.
CHUNKS_KEPT, WORDS_KEPT = 250_000, 150_000
#: Arcs tabulated by a worker before it starts afresh.
ARCS_KEPT = 500_000
#: Chunks longer than this are encoded but not kept.
LONGEST_KEPT = 48
#: A space after white space: such texts are not cut at spaces before they are split.
_RUNS = [chr(i) + " " for i in range(0x3001) if chr(i).isspace()]
#: Fixed value: the pre-splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the others from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Tokenization automaton of a merge list.

    ``labels`` gives each token's bytes, ``merges`` pairs of tokens in order.
    """

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int]]):
        self.labels = labels
        self.ids = {v: k for k, v in labels.items()}
        top = max(labels, default=0) + 1
        # States: a copy's parent, the label it lost and the merge that made it; state 0 is the start.
        self.parent, self.lost, self.born = [0], [-1], [-1]
        self.target = [0] * top  # state that the arcs with a label lead to
        self.made = [-1] * top  # merge that made the label, -1 for bytes
        self.first = [-1] * top  # its left part
        for k, (a, b) in enumerate(merges):
            self._gadget(k, a, b)
        self._index()
        self._spell()

    def _spell(self) -> None:
        """A trie of the labels: its arcs, each node's depth and fall-back (the longest end of it that is a node), and the labels that end there."""
        self.step: dict[int, int] = {}
        self.back = [0]
        depth = [0]
        own = [-1]
        level: list[tuple[int, bytes]] = []
        for label, token in self.ids.items():
            node = 0
            for byte in label:
                nxt = self.step.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.step[node << 8 | byte] = len(own)
                    own.append(-1)
                    depth.append(depth[node] + 1)
                    self.back.append(0)
                    level.append((node, byte))
                node = nxt
            own[node] = token
        self.width = [0] * len(self.target)
        for label, token in self.ids.items():
            self.width[token] = len(label)
        # Shorter nodes first: a node falls back to where its parent's fall-backs go by its byte.
        order = sorted(range(1, len(own)), key=depth.__getitem__)
        self.ends: list[int] = [-1] * len(own)  # longest label that ends the node
        self.shorter: list[int] = [0] * len(own)  # next node along the fall-backs that has one
        for node in order:
            parent, byte = level[node - 1]
            if parent:
                self.back[node] = self._goto(self.back[parent], byte)
            back = self.back[node]
            self.ends[node] = own[node] if own[node] >= 0 else self.ends[back]
            self.shorter[node] = (back if own[node] >= 0 else self.shorter[back]) if self.ends[node] >= 0 else 0
        self.names = [str(i) for i in range(len(self.target))]
        self.bytes: dict[int, int] = {}  # the byte table: node and byte -> node
        self.arcs: dict[int, bool] = {}  # the arc table: label before and label

    def _goto(self, node: int, byte: int) -> int:
        while (nxt := self.step.get(node << 8 | byte)) is None:
            if not node:
                return 0
            node = self.back[node]
        return nxt

    def _gadget(self, k: int, a: int, b: int) -> None:
        c = self.ids[self.labels[a] + self.labels[b]]
        p, after = self.target[a], self.target[b]
        self.parent.append(p)
        self.lost.append(b)
        self.born.append(k)
        self.target[a] = len(self.parent) - 1
        self.target[c], self.made[c], self.first[c] = after, k, a

    def _index(self) -> None:
        """Cut each chain of copies where another chain joins it, so that a lookup jumps over whole runs of copies."""
        n = len(self.parent)
        children = [0] * n
        for s in range(1, n):
            children[self.parent[s]] += 1
        used = set(self.target)
        self.run = [0] * n  # run of each state
        runs: list[dict[int, int]] = [{}]  # lost label -> state, per run
        above = [0]  # state below the first of the run
        for s in range(1, n):
            p = self.parent[s]
            if p and children[p] == 1 and (self.run[p] or p not in used):
                self.run[s] = self.run[p]
            else:
                self.run[s] = len(runs)
                runs.append({})
                above.append(p)
            runs[self.run[s]][self.lost[s]] = s
        self.runs, self.above = runs, above

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc labelled ``token``.

        An arc made after the state stands for an arc with its left part; an
        older arc is there unless a copy on the chain has lost it since.
        """
        spine, until = [], 1 << 60
        while token >= 0:
            spine.append((token, until))  # this label stands for the arc in copies made up to `until`
            until = self.made[token]
            token = self.first[token]
        while state:
            lost = self.runs[self.run[state]]
            for t, until in spine:
                s = lost.get(t)
                if s is not None and s <= state and self.born[s] <= until:
                    return False
            state = self.above[self.run[state]]
        return True

    def _arc(self, before: int, token: int) -> bool:
        if len(self.arcs) > ARCS_KEPT:
            self.arcs.clear()
        got = self.arcs[before << 20 | token] = self.has_arc(self.target[before], token)
        return got

    def encode(self, word: bytes) -> list[str]:
        """Tokens of a pre-split word, in decimal."""
        step, arcs, ends, shorter, width, names = self.bytes.get, self.arcs.get, self.ends, self.shorter, self.width, self.names
        last = [-1]  # last arc of each prefix's path
        node = at = 0
        for byte in word:
            at += 1
            to = step(node << 8 | byte)
            if to is None:
                to = self.bytes[node << 8 | byte] = self._goto(node, byte)
            node = end = to
            while True:
                token = ends[end]
                if token < 0:
                    raise ValueError(f"byte {byte} has no token")
                before = last[at - width[token]]
                if before < 0:
                    break
                known = arcs(before << 20 | token)
                if known or known is None and self._arc(before, token):
                    break
                end = shorter[end]
            last.append(token)
        path = []
        while at:
            token = last[at]
            path.append(names[token])
            at -= width[token]
        path.reverse()
        return path


class Codec:
    """Encodes and decodes whole texts with an automaton, special strings included."""

    def __init__(self, spec: str):
        import regex

        data = json.loads(spec)
        model, letters = data["model"], byte_letters()
        if model["type"] != "BPE" or data.get("normalizer") or (data["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE file without normalizer is needed")
        raw = {t: bytes(map(letters.__getitem__, t)) for t in model["vocab"] if all(c in letters for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        self.automaton = Automaton({vocab[t]: b for t, b in raw.items()}, [(vocab[a], vocab[b]) for a, b in merges])
        self.specials = {x["content"]: x["id"] for x in data["added_tokens"] if x["special"]}
        self.labels = {str(i): b for i, b in self.automaton.labels.items()} | {str(i): t.encode() for t, i in self.specials.items()}
        self.split = regex.compile(PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.chunks: dict[str, str] = {}  # after a space
        self.older: dict[str, str] = {}
        self.words: dict[str, str] = {}  # pre-split
        self.older_words: dict[str, str] = {}

    def _plain(self, text: str) -> str:
        found = self.split(text)
        return self._word(found[0]) if len(found) == 1 else ",".join(map(self._word, found))

    def _word(self, word: str) -> str:
        got = self.words.get(word)
        if got is None:
            got = self.older_words.get(word) or ",".join(self.automaton.encode(word.encode()))
            if len(word) <= LONGEST_KEPT:
                if len(self.words) >= WORDS_KEPT:
                    self.older_words, self.words = self.words, {}
                self.words[word] = got
        return got

    def _segment(self, text: str) -> str:
        if text[-1] == " " or text[0] == " " or any(x in text for x in _RUNS):
            return self._plain(text)
        head, *parts = text.split(" ")
        known, make = self.chunks.get, self._chunk
        return ",".join([self._plain(head), *[known(p) or make(p) for p in parts]])

    def _chunk(self, part: str) -> str:
        got = self.older.get(part)
        if got is None:
            got = self._plain(" " + part)
        if len(part) <= LONGEST_KEPT:
            if len(self.chunks) >= CHUNKS_KEPT:
                self.older, self.chunks = self.chunks, {}
            self.chunks[part] = got
        return got

    def encode_csv(self, text: str | None) -> str:
        """Decimal ids joined by commas."""
        if not text:
            return ""
        if self.cut is None or "<" not in text or not self.cut.search(text):
            return self._segment(text)
        return ",".join([str(self.specials[s]) if s in self.specials else self._segment(s) for s in self.cut.split(text) if s])

    def decode_csv(self, ids: str) -> bytes:
        """Labels of the arcs, joined."""
        return b"".join(map(self.labels.__getitem__, ids.split(","))) if ids else b""


def ids_and_text(csv: str, decoded: bytes) -> dict:
    """The operator's own output of one document."""
    return {"ids": list(map(int, csv.split(","))) if csv else [], "decoded": decoded.decode("utf-8", "replace")}


IDS_AND_TEXT = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
IDS_AND_TEXT_DDL = "struct<ids: array<int>, decoded: string>"


def bpe_codec(
    df: DataFrame,
    tokenizer: str,
    text: str = "text",
    into: str = "bpe",
    derive: Callable[[str, bytes], dict] = ids_and_text,
    ddl: str = IDS_AND_TEXT_DDL,
    arrow: pa.DataType = IDS_AND_TEXT,
) -> DataFrame:
    """Encode each whole text and decode the ids again; add struct ``into``.

    By default it holds ``ids`` and ``decoded``; ``derive`` may turn these (ids
    in decimal joined by commas, decoded bytes) into other columns within the
    same pass, so that large id arrays need not leave the worker.
    ``tokenizer`` is the path of a byte-level BPE file on the driver; its
    content travels with the function.  Null and empty texts give no ids and an
    empty text; texts of any length are encoded whole; repeated rows are
    encoded each; an empty table stays empty; other columns are kept, and
    ``into`` gets underscores if the name is taken.
    """
    ship(df.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()

    @F.arrow_udf(ddl)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = hold(("bpe", hash(spec)), lambda: Codec(spec))
        for batch in batches:
            out = []
            for value in batch:
                csv = codec.encode_csv(value.as_py())
                out.append(derive(csv, codec.decode_csv(csv)))
            yield pa.array(out, arrow)

    return df.withColumn(fresh(df, into), run.asNondeterministic()(F.col(text)))

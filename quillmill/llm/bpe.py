"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a word is a chain: its last token, preceded by the encoding of
what stands before that token. So each node of a trie of words needs one value,
the last token of the encoding of the node's prefix; it is found from the values
of shorter prefixes, and words with a common prefix share the work.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quillmill.llm.common import through

END = "</w>"
#: The letter of a word's end in the trie of tokens; byte letters are below it.
CLOSE = 511
#: White space as the vocabulary's own pattern takes it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class TrieBPE:
    """Encoder for a byte-level BPE with word ends, as ``tokenizers`` stores it.

    ``encode_words`` takes distinct pre-tokens in byte letters. ``encode`` and
    ``decode`` work on whole texts.
    """

    def __init__(self, path: str, most: int = 100_000):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        vocab: dict[str, int] = model["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.vocab = vocab
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.raw = {i: i.to_bytes(4, "little") for i in self.token}
        self.pairs: dict[tuple[int, int], int] = {}  # the rank of a merge, and so the order of its product
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for n, (x, y) in enumerate(merges):
            made = vocab[x + y]
            self.pairs.setdefault((vocab[x], vocab[y]), n)
            if made not in self.parts:
                self.parts[made], self.rank[made] = (vocab[x], vocab[y]), n
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(END)}
        self.final = {t.removesuffix(END): i for t, i in vocab.items() if t.endswith(END)}
        self.sound: dict[int, bool] = {}
        self.agree: dict[int, bool] = {}  # by x << 20 | y
        self.letters = dict(enumerate(byte_letters()))
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^ \p{L}\p{N}]+").findall
        self.spaces = re.compile(f"[{SPACE}]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.odd = re.compile("[\x1c-\x1f]")
        self.most = most
        self.build()
        del self.inner, self.final
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.known: dict[str, tuple[bytes, str]] = {}

    # -- the chain of last tokens

    def merged(self, symbols: list[int]) -> list[int]:
        """Plain merging; used once for each token of the vocabulary that a word meets."""
        while len(symbols) > 1:
            n, i = min((self.pairs.get(p, len(self.pairs)), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if n == len(self.pairs):
                break
            symbols[i : i + 2] = [self.vocab[self.token[symbols[i]] + self.token[symbols[i + 1]]]]
        return symbols

    def is_sound(self, t: int) -> bool:
        """Whether merging the token's own letters gives the token."""
        if (known := self.sound.get(t)) is None:
            name = self.token[t]
            last = name.endswith(END) and len(name) > len(END)
            letters = list(name.removesuffix(END) if last else name)
            if last:
                letters[-1] += END
            known = self.sound[t] = self.merged([self.vocab[x] for x in letters]) == [t]
        return known

    def agrees(self, x: int, y: int) -> bool:
        """Whether merging the letters of tokens x and y gives just these two.

        Walks both tokens' merges backwards along their border, latest first, and
        looks for a merge across the border that would have come earlier.
        """
        if (known := self.agree.get(x << 20 | y)) is not None:
            return known
        a, b, rank, far = x, y, self.rank, len(self.pairs)
        # a merge across the border wins over the merge that made a if its rank is lower,
        # and over the one that made b if lower or equal, as it stands to the left of it
        before_a = before_b = far
        ok = True
        while True:
            n = self.pairs.get((a, b), far)
            if n < far and n < before_a and n <= before_b:
                ok = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra >= rb:
                before_a, a = ra, self.parts[a][1]
            else:
                before_b, b = rb, self.parts[b][0]
        self.agree[x << 20 | y] = ok
        return ok

    # -- which tokens end at a place of a word

    def build(self) -> None:
        """A trie of all tokens with, for each node, the node of its longest proper suffix in the trie.

        A node is a number, an edge ``node << 9 | letter``; CLOSE is the letter of a
        word's end. So one step a letter gives all tokens that end there, and none
        that does not is tried.
        """
        self.edges: dict[int, int] = {}
        self.ends: list[int] = [-1]
        edges, ends, levels = self.edges, self.ends, []
        for names, close in ((self.inner, ()), (self.final, (CLOSE,))):
            for name, t in names.items():
                at = 0
                for depth, c in enumerate((*map(ord, name), *close)):
                    key = at << 9 | c
                    at = edges.get(key, 0)
                    if not at:
                        at = edges[key] = len(ends)
                        ends.append(-1)
                        if depth == len(levels):
                            levels.append([])
                        levels[depth].append(key)
                ends[at] = t
        self.suffix = suffix = array("i", bytes(4 * len(ends)))
        for keys in levels[1:]:
            for key in keys:
                suffix[edges[key]] = self.step(suffix[key >> 9], key & 511)
        self.tokens_at: dict[int, tuple[tuple[int, int], ...]] = {}
        self.first: dict[int, tuple[int, int, int]] = {}  # a node with its longest token and that one's letters
        self.moves: dict[int, tuple[int, int, int]] = {}  # steps taken before

    def step(self, at: int, c: int) -> int:
        """The node of the longest suffix in the trie after one more letter."""
        edges = self.edges
        while (to := edges.get(at << 9 | c)) is None:
            if not at:
                return 0
            at = self.suffix[at]
        return to

    def moved(self, key: int) -> tuple[int, int, int]:
        at = self.step(key >> 9, key & 511)
        if (to := self.first.get(at)) is None:
            to = self.first[at] = (at, *(self.ending(at) or ((-1, 0),))[0])
        self.moves[key] = to
        return to

    def ending(self, at: int) -> tuple[tuple[int, int], ...]:
        """(token, letters) of the sound tokens that end at a node, longest first."""
        out, node = [], at
        while node:
            if (t := self.ends[node]) >= 0 and self.is_sound(t):
                out.append((t, len(self.token[t].removesuffix(END)) if self.token[t] != END else 0))
            node = self.suffix[node]
        found = self.tokens_at[at] = tuple(out)
        return found

    def last_token(self, last: list[int], n: int, at: int) -> int:
        """The last token of the encoding of a prefix of n letters, whose node is ``at``, from those of shorter prefixes."""
        known = self.agree.get
        for t, size in self.tokens_at.get(at) or self.ending(at):
            if size == n:
                return t
            before = last[n - size]
            ok = known(before << 20 | t)
            if self.agrees(before, t) if ok is None else ok:
                return t
        raise ValueError(at)

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """Ids and tokens of each distinct word, by a depth-first walk of the words' trie.

        Sorted words are a trie's leaves in depth-first order, so the trie is not
        built: ``last`` holds the states on the path to the word at hand, and a word
        goes on from the node where it leaves its predecessor.
        """
        out: dict[str, tuple[bytes, str]] = {}
        last: list[int] = [-1]
        nodes: list[int] = [0]
        token, last_token, raw = self.token, self.last_token, self.raw
        for kept in (self.agree, self.moves):
            if len(kept) > 2 * self.most:
                kept.clear()
        move, known = self.moves.get, self.agree.get
        before = ""
        for word in sorted(words):
            end, shared = len(word), 0
            for x, y in zip(before, word[:-1], strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], nodes[shared + 1 :]
            at = nodes[-1]
            for n in range(len(last), end):
                key = at << 9 | ord(word[n - 1])
                at, t, size = move(key) or self.moved(key)
                nodes.append(at)
                # the first token mostly fits
                last.append(t if size == n or known(last[n - size] << 20 | t) else last_token(last, n, at))
            before = word[: len(last) - 1]
            key = at << 9 | ord(word[-1])
            key = (move(key) or self.moved(key))[0] << 9 | CLOSE
            t = last_token(last, end, (move(key) or self.moved(key))[0])
            n = end + len(END) - len(token[t])
            if not n:
                out[word] = raw[t], token[t]
                continue
            ids = [t]
            while n:
                t = last[n]
                ids.append(t)
                n -= len(token[t])
            ids.reverse()
            out[word] = b"".join([raw[t] for t in ids]), " ".join([token[t] for t in ids])
        return out

    # -- whole texts

    def chunk_pieces(self, chunk: str) -> list[str]:
        """Pre-tokens, in byte letters, of a text without white space."""
        if chunk.isascii() and chunk.isprintable():
            low = chunk.lower()
            return [low] if low.isalpha() else self.pieces(low)
        low = unicodedata.normalize("NFC", chunk).replace("\u03a3", "\u03c3").lower()
        return [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.letters) for p in ([low] if low.isalpha() else self.pieces(low))]

    def learn(self, chunks: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """Ids (little-endian) and decoded tokens of chunks, all in one trie; kept for later texts."""
        new = {c: self.chunk_pieces(c) for c in chunks}
        known = self.known
        if len(known) > self.most:
            known = self.known = {}
        known |= self.encode_words({p for ps in new.values() for p in ps if p not in known})
        return {c: known[ps[0]] if len(ps) == 1 else (b"".join([known[p][0] for p in ps]), " ".join([known[p][1] for p in ps])) for c, ps in new.items()}

    def split(self, text: str) -> list[str]:
        if self.odd.search(text):
            return [c for c in self.spaces.split(text) if c]
        return text.split()

    def parts_of(self, text: str) -> list[tuple[bool, list[str]]]:
        """Runs of a text: chunks of ordinary text, or one special token."""
        if "<|" not in text:
            return [(False, self.split(text))]
        return [(bool(i % 2), [x] if i % 2 else self.split(x)) for i, x in enumerate(self.specials.split(text)) if x]

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Per text its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        runs = [self.parts_of(t or "") for t in texts]
        chunks = set().union(*(cs for r in runs for special, cs in r if not special))
        table = {}
        fresh = []
        for c in chunks:
            got = self.young.get(c)
            if got is None and (got := self.old.get(c)) is not None:
                self.young[c] = got
            if got is None:
                fresh.append(c)
            else:
                table[c] = got
        for i in range(0, len(fresh), 20_000):
            made = self.learn(fresh[i : i + 20_000])
            table |= made
            self.young |= made
            if len(self.young) > self.most:
                self.young, self.old = {}, self.young
        for r in runs:
            got = []
            for special, cs in r:
                got += [(self.raw[self.special[c]], c) for c in cs] if special else map(table.__getitem__, cs)
            yield b"".join([x for x, _ in got]), " ".join([x for _, x in got if x])

    def encode(self, text: str | None) -> list[int]:
        raw = next(self.encode_batch([text]))[0]
        return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.token[i] for i in ids)


@cache
def encoder(path: str) -> TrieBPE:
    """One encoder a Python worker, which reads the vocabulary once for all its tasks."""
    return TrieBPE(path)


def bpe_encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), full: bool = False, step_bytes: int = 1 << 20) -> DataFrame:
    """Encode and decode each whole text; one narrow pass, no shuffle.

    Returns the ``keep`` columns, then n_tokens, ids_sha256, decoded_sha256 and,
    with ``full``, ids (array<int>) and decoded. A null or empty text has no
    tokens and the empty string's digests; repeated rows give repeated results.
    ``path`` must be readable on executors (it lies in an installed package).
    Texts are taken ``step_bytes`` at a time, so memory follows the longest text.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>", "decoded string"] if full else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            kept, texts = batch.select(list(keep)), batch.column(batch.schema.get_field_index(text))
            start = size = 0
            for i in range(len(batch)):
                size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
                if size < step_bytes and i + 1 < len(batch):
                    continue
                got = list(bpe.encode_batch(texts.slice(start, i + 1 - start).to_pylist()))
                cols = [*kept.slice(start, i + 1 - start).columns, pa.array([len(x) // 4 for x, _ in got], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in got]), pa.array([hashlib.sha256(x.encode()).hexdigest() for _, x in got])]
                if full:
                    cols += [pa.array([memoryview(x).cast("I").tolist() for x, _ in got], pa.list_(pa.int32())), pa.array([x for _, x in got])]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if full else [])])
                start, size = i + 1, 0

    return through(docs.select(*dict.fromkeys([*keep, text])), run, schema)

"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Encoding a word reads its symbols one by one. For each prefix exactly one token can end it: the longest that is its
own encoding and forms a valid pair with the token that ends the rest of the prefix, where a pair is valid if the
merges, applied to both together, give the two again. A token is emitted once it is stable, when the last tokens of
all prefixes that may still matter descend from it. How many symbols that can take at most, the lookahead, follows
from the merge list: a merge decision depends on what follows only through a chain of ever earlier merges. The state
is a window of the longest token's length, so memory does not grow with the word or the text. A word of at most two
windows is decided at its end by the same steps, and neighbours in alphabetical order share the steps of what they
begin with.

Decoding is an incremental machine, fed token by token (Decoder). Where the file names no decoder, the text is the
tokens' names with a blank between them, and the machine's state is whether a blank is due; otherwise it goes from
bytes to text, holds back the bytes of an unfinished character, and puts replacement characters for invalid ones.

Null texts count as empty and have no tokens. The vocabulary is a tokenizers file; special tokens in a text are
found before anything else, as that library does.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE, AHEAD = 600_000, 4_000_000
#: Characters that the runs of text that are kept with their ids may have together, with what they decode to.
HELD = 48_000_000
ENCODED = "doc_id long, ids string, n_tokens long, decoded string"
_loaded: dict[str, Bpe] = {}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from 256 on, in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(kept))}
    return [chr(rest.get(b, b)) for b in range(256)]


class Bpe:
    """A merge list over symbols, with the encoder's tables."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = "", special: dict[str, int] | None = None):
        self.ids, self.end, self.special = vocabulary, end, special or {}
        self.names = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.longest = max((self.symbols(t) for t in vocabulary), default=1)
        self.lookahead = self._lookahead(merges)
        #: every ending of a token that is its own encoding; 1 for the token itself
        self.endings: dict[str, int] = {}
        for token in vocabulary:
            if self.merged(own := self.split(token)) == [token]:
                tail = ""
                for symbol in reversed(own):
                    tail = symbol + tail
                    self.endings.setdefault(tail, 0)
                self.endings[token] = 1
        self._pairs: dict[tuple[str, str], bool] = {}
        self._before, self._trail = "", []

    def symbols(self, token: str) -> int:
        """How many symbols a token covers: the end mark belongs to the last one."""
        return len(token) - len(self.end) if self.end and token.endswith(self.end) and token != self.end else len(token)

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Symbols after a token that can still change it, at most.

        Whether a token's last merge stands is decided once it is known whether an earlier merge takes its right part
        away. Such a merge begins with that part, or with a token that ends it, and is decided in its turn by merges
        still earlier; so chains get ever earlier and cannot be longer than the longest run of merges in which
        the left part of each is a suffix of the right part of the next.
        """
        depth: dict[str, int] = {}
        most = 1
        for left, right in merges:
            # the longest chain that begins with a merge whose left part ends this merge's right part
            chain = max((depth.get(right[k:], 0) for k in range(len(right))), default=0) + self.symbols(right)
            depth[left] = max(depth.get(left, 0), chain)
            most = max(most, chain)
        return most + self.longest

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges applied to a short run of symbols: the earliest rule first, from the left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min(((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            k = best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def split(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def valid(self, left: str, right: str) -> bool:
        """Whether the two tokens side by side stay the two."""
        pair = (left, right)
        if (known := self._pairs.get(pair)) is None:
            if len(self._pairs) > CACHE:
                self._pairs.clear()
            known = self._pairs[pair] = self.merged(self.split(left) + self.split(right)) == [left, right]
        return known

    def _last(self, before: str, symbol: str, back: list[str]) -> str:
        """The last token of the prefix before + symbol; back[-n] is the last token of the prefix n symbols shorter.

        The longest that goes is the one; a single symbol always does.
        """
        endings, n = self.endings, len(back)
        token, found, size, at = symbol, [], 1, len(before)
        while (whole := endings.get(token)) is not None:
            if whole:
                found.append((size, token))
            if size > n:
                break
            at -= 1
            size += 1
            token = before[at:] + symbol
        for size, token in reversed(found):
            if size > n:
                return token
            valid = self._pairs.get((back[-size], token))
            if valid or valid is None and self.valid(back[-size], token):
                return token
        return symbol

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a run of symbols, each as soon as it is stable; the window is all that is kept.

        The prefixes' last tokens form a tree. Tokens on the way to all prefixes of the last `longest` symbols are
        stable, as any later prefix goes back to one of these.
        """
        text = ""  # the symbols' characters since the last emission, the last symbol apart
        last: list[str] = []  # the last token of each prefix since then
        for symbol in symbols:
            last.append(self._last(text, symbol, last))
            text += symbol
            if len(last) >= 2 * self.lookahead:
                ways = [self._way(last, k) for k in range(max(0, len(last) - self.longest), len(last))]
                same = 0
                while all(len(w) > same + 1 and w[same] == ways[0][same] for w in ways):
                    same += 1
                stable = ways[0][:same]
                yield from stable
                gone = sum(map(len, stable))
                text, last = text[gone:], last[gone:]
        if last:
            yield from self._way(last, len(last) - 1)

    def _way(self, last: list[str], k: int) -> list[str]:
        out = []
        while k >= 0:
            out.append(last[k])
            k -= self.symbols(last[k])
        return out[::-1]

    def word(self, body: str) -> list[str]:
        """Tokens of one word. A word that begins as the one before it goes on from the prefix that they share."""
        if len(body) > 2 * self.longest:
            return list(self.stream([*body[:-1], body[-1] + self.end]))
        before, n, k = self._before, min(len(self._before), len(body) - 1), 0
        while k < n and before[k] == body[k]:
            k += 1
        last = self._trail[:k]
        for k in range(k, len(body) - 1):
            last.append(self._last(body[:k], body[k], last))
        self._before, self._trail = body[:-1], last
        token = self._last(body[:-1], body[-1] + self.end, last)
        out, k = [token], len(body) - 1 - self.symbols(token)
        while k >= 0:
            out.append(token := last[k])
            k -= len(token)
        out.reverse()
        return out


class WordPieces:
    """A tokenizers file whose words are found by a pattern in normalised text and mapped byte by byte."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # its tables of characters decide what a word is in scripts where tables may differ
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, splitter = file["model"], file["pre_tokenizer"]["pretokenizers"][0]
        self.bpe = Bpe(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "", {t["content"]: t["id"] for t in file["added_tokens"]})
        self.pattern = regex.compile(splitter["pattern"]["Regex"], regex.V0)
        self.special = regex.compile("|".join(map(regex.escape, self.bpe.special))) if self.bpe.special else None
        self.letters = str.maketrans(dict(enumerate(byte_alphabet())))
        self.common = regex.compile("[\x09-\x0d\x20-\x7e\xa0\xa1\xa7\xab\xb0\xb1\xb4\xb6\xb7\xbb\xbf-\u017f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027\u20ac]*")
        self.after_mark = re.compile(r"[^\w\s][.,]|_[.,]")
        self.decoder = file["decoder"]
        self.known: dict[str, tuple[str, str, int]] = {}
        self.held = 0

    def normalised(self, text: str) -> str:
        """NFC, and lower case character by character: a sigma at a word's end is like any other."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _joined(self, words: list[str]) -> tuple[str, str, int]:
        """Ids of words in the byte alphabet, joined by spaces, what they decode to within a text, and how many."""
        ids = []
        for word in words:
            ids += [self.bpe.ids[t] for t in self.bpe.word(word) if t in self.bpe.ids]
        machine = Decoder(self, begun=True)
        return " ".join(map(str, ids)), "".join([machine.feed(i) for i in ids]), len(ids)

    def _run(self, run: str) -> tuple[str, str, int]:
        words = self.pattern.findall(run)
        return self._joined(words if run.isascii() else [w.encode().decode("latin-1").translate(self.letters) for w in words])

    def _split(self, text: str) -> list[str]:
        """The runs between white space; commas and full stops begin runs of their own, as they begin words, unless one
        follows another mark, with which it is a word."""
        plain = self.normalised(text)
        if not self.after_mark.search(plain):
            plain = plain.replace(",", " ,").replace(".", " .")
        return plain.split()

    def prepare(self, texts: Iterable[str | None]) -> None:
        """Encode the runs of these texts ahead, in their alphabetical order, in which neighbours begin alike."""
        if self.held > HELD:
            self.known, self.held = {}, 0
        fresh: set[str] = set()
        for text in texts:
            if text and self.common.fullmatch(text):
                fresh.update(self._split(text))
        for run in sorted(fresh - self.known.keys()):
            ids, decoded, _ = self.known[run] = self._run(run)
            self.held += len(run) + len(ids) + len(decoded)

    def _runs(self, text: str) -> list[tuple[str, str, int]]:
        """What the runs of a text between white space give."""
        if not self.common.fullmatch(text):
            plain = self.library.normalizer.normalize_str(text)
            return [self._joined([w]) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        known = self.known
        return [known.get(run) or self._run(run) for run in self._split(text)]

    def pieces(self, text: str) -> list[tuple[str, str, int]]:
        """(ids, their text, how many) of the parts of a text, in order."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += self._runs(text[at : m.start()])
            out.append((str(self.bpe.special[m[0]]), Decoder(self, begun=True).feed(self.bpe.special[m[0]]), 1))
            at = m.end()
        return [p for p in out + self._runs(text[at:] if at else text) if p[2]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.pieces(text) for i in ids.split()]

    def decode(self, ids: Iterable[int]) -> str:
        machine = Decoder(self)
        return "".join([machine.feed(i) for i in ids]) + machine.finish()


class Decoder:
    """Text from token after token. begun: whether tokens came before."""

    def __init__(self, pieces: WordPieces, begun: bool = False):
        self.bpe, self.begun, self.named = pieces.bpe, begun, pieces.decoder is None
        self.bytes = None if self.named else BytesToText(pieces.bpe)

    def feed(self, token: int) -> str:
        if not self.named:
            return self.bytes.feed(token)
        name = self.bpe.names.get(token)
        if name is None:
            return ""
        blank, self.begun = " " if self.begun else "", True
        return blank + name

    def finish(self) -> str:
        return "" if self.named else self.bytes.finish()


class BytesToText:
    """Text from the bytes of token after token: an unfinished character waits for the next token's bytes."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        name = self.bpe.names.get(token, "")
        if name in self.bpe.special:
            return self.finish() + name
        end = bool(self.bpe.end) and name.endswith(self.bpe.end)
        body = name[: -len(self.bpe.end)] if end else name
        out = self.machine.decode(bytes(self.byte[c] for c in body))
        return out + self.finish() + " " if end else out

    def finish(self) -> str:
        out = self.machine.decode(b"", final=True)
        self.machine.reset()
        return out


def loaded(path: str) -> WordPieces:
    if path not in _loaded:
        _loaded[path] = WordPieces(path)
    return _loaded[path]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """For each of docs (doc_id, text): ids joined by spaces, their number, and the text that they decode to.

    Decoding goes by the ids alone, through the incremental machine; what a run's ids give is kept with them, and a
    text's are put together in order. A null id is kept, rows that repeat stay, and an empty table gives no rows.
    vocabulary is a path that every worker can read; its file must name no decoder or a byte-level one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(vocabulary)
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).to_pylist()
            ready = 0
            for first in range(0, len(texts), 100):
                if first >= ready:
                    size, ready = 0, first
                    while ready < len(texts) and (size < AHEAD or ready % 100):
                        size, ready = size + len(texts[ready] or ""), ready + 1
                    own.prepare(texts[first:ready])
                ids, counts, decoded = [], [], []
                for text in texts[first : first + 100]:
                    found = own.pieces(text or "")
                    ids.append(" ".join([p[0] for p in found]))
                    decoded.append("".join([p[1] for p in found])[own.decoder is None :])
                    counts.append(sum([p[2] for p in found]))
                yield pa.RecordBatch.from_arrays([docs.slice(first, 100), pa.array(ids), pa.array(counts, pa.int64()), pa.array(decoded)], names=["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(rows, ENCODED)

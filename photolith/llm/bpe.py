"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as a state machine.

A merge decides about its pair once everything that can reach the pair from the right is known. `Merges`
computes from the merge list how far that is: a merge waits for the pieces that its right symbol needs, and for
earlier merges that compete for that symbol, which wait in turn. Symbols further than this lookahead before
the end of what has been read are stable; they're emitted and leave the buffer, so encoding a word of any
length keeps a buffer of constant size. Tokens that begin at a token boundary don't depend on what is before
it, so the rest of the buffer can be taken up again as it is.

`Encoder` reads a text in pieces that end where no token can cross (white space, or a change of class), and keeps
a bounded memo of the transducer's output for short words. `Decoder` takes ids in batches of any size.

Defined cases: a null or empty text has no tokens; the vocabulary's special strings inside a text are their ids,
as the tokenizers library has it; repeated rows are encoded each on its own; a null id column value stays null;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from photolith.llm._bytes import columns, map_texts, with_own_id

PIECE = 1 << 16
MEMO_WORDS = 150_000
MEMO_LENGTH = 64
END = "</w>"
NEVER = (1 << 62, -1)

#: The vocabulary file's own white space and word patterns.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
CUT = regex.compile(rf"[{SPACE}]|(?<=[\p{{L}}\p{{N}}])(?=[!-&(-/:;=-@\[-`{{-~])")

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Merges:
    """The merge list over vocabulary ids, and the lookahead (in bytes) that suffices for it."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        letters = byte_alphabet()
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + END] for c in letters]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        for rank, (a, b) in enumerate(pairs):
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.lookahead = self._lookahead(pairs)

    @staticmethod
    def _lookahead(pairs: list[list[str]]) -> int:
        """The furthest byte right of a boundary on which a merge across it can depend."""
        size = lambda s: len(s.removesuffix(END))
        wait: dict[str, int] = {}  # of a token: how far beyond the boundary inside it its own last merge looks, from the token's start
        contest: dict[str, int] = {}  # of a symbol: how far from its start the earlier merges look that would take it as their left part
        most = 0
        for a, b in pairs:
            far = max(size(b), wait.get(b, 0), contest.get(b, 0), wait.get(a, 0) - size(a), contest.get(a, 0) - size(a))
            whole = size(a) + far
            wait[a + b] = max(wait.get(a + b, 0), whole)
            contest[a] = max(contest.get(a, 0), whole)
            most = max(most, far)
        return most

    def symbols(self, raw: bytes, final: bool) -> list[int]:
        out = [self.inner[b] for b in raw]
        if final and raw:
            out[-1] = self.final[raw[-1]]
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """All merges of a run of symbols: lowest rank first, leftmost first."""
        pairs, n = self.pairs, len(symbols)
        if n < 24:
            get = pairs.get
            found = [get(x, NEVER) for x in zip(symbols, symbols[1:], strict=False)]
            while found:
                best = min(found)
                if best is NEVER:
                    break
                at = found.index(best)
                symbols[at : at + 2] = [best[1]]
                del found[at]
                if at < len(found):
                    found[at] = get((best[1], symbols[at + 1]), NEVER)
                if at:
                    found[at - 1] = get((symbols[at - 1], best[1]), NEVER)
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(f[0], i, f[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (f := pairs.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i] if symbols[i] == left else n
            if j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if f := pairs.get((made, symbols[k])):
                    heapq.heappush(heap, (f[0], i, f[1], made, symbols[k]))
            h = before[i]
            if h >= 0 and (f := pairs.get((symbols[h], made))):
                heapq.heappush(heap, (f[0], h, f[1], symbols[h], made))
        return [s for s in symbols if s >= 0]


class WordStream:
    """Tokens of one word whose bytes come in parts."""

    def __init__(self, merges: Merges, length: list[int]):
        self.merges, self.length = merges, length
        self.block = 4 * merges.lookahead + 64
        self.buffer = b""

    def feed(self, raw: bytes) -> Iterator[int]:
        at = 0
        while at < len(raw):
            take = max(1, self.block - len(self.buffer))
            self.buffer += raw[at : at + take]
            at += take
            if len(self.buffer) >= self.block:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        # The last byte may turn out to be the word's last, which is another symbol, so it's kept back.
        tokens, end = self.merges.merge(self.merges.symbols(self.buffer, final=False)), 0
        limit = len(self.buffer) - self.merges.lookahead - 1
        for t in tokens:
            if end + self.length[t] > limit:
                break
            end += self.length[t]
            yield t
        self.buffer = self.buffer[end:]

    def finish(self) -> list[int]:
        out, self.buffer = self.merges.merge(self.merges.symbols(self.buffer, final=True)), b""
        return out


class _Memo(dict):
    """Ids of words as text, made by the transducer where they aren't kept."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> str:
        out = " ".join(map(str, self.encoder.word(word)))
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = out
        return out


class Encoder:
    """Ids of whole texts under a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        text_of = {i: t for t, i in self.merges.vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [text_of.get(i, "") for i in range(max(text_of) + 1)]
        self.length = [len(t.removesuffix(END)) for t in self.tokens]
        self.reach = max(map(len, self.special), default=0)
        self.memo = _Memo(self)

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) <= MEMO_LENGTH:  # nothing can be stable before the end of so short a word
            return self.merges.merge(self.merges.symbols(raw, final=True))
        stream = WordStream(self.merges, self.length)
        return [*stream.feed(raw), *stream.finish()]

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of a text that no token crosses, of about PIECE characters where the text allows it."""
        at = 0
        while len(text) - at > 2 * PIECE:
            cut = CUT.search(text, at + PIECE)
            while cut and any(text.find(s, max(at, cut.start() - len(s) + 1), cut.start() + len(s) - 1) >= 0 for s in self.special):
                cut = CUT.search(text, cut.start() + 1)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def ids_text(self, text: str | None) -> Iterator[str]:
        """The ids of each piece, in decimal with spaces between; pieces without tokens are left out."""
        for piece in self.pieces(text or ""):
            for part in self.split.split(piece) if "<|" in piece else (piece,):
                if part in self.special:
                    yield str(self.special[part])
                    continue
                if not unicodedata.is_normalized("NFC", part):
                    part = unicodedata.normalize("NFC", part)
                if "Σ" in part:
                    part = part.replace("Σ", "σ")
                if words := WORD.findall(part.lower()):
                    yield " ".join(map(self.memo.__getitem__, words))

    def encode(self, text: str | None) -> Iterator[int]:
        for piece in self.ids_text(text):
            yield from map(int, piece.split(" "))


class Decoder:
    """Text of ids that come in batches: an incremental machine from bytes to text.

    Every token stands for some bytes; bytes that don't make a character yet are kept until the next batch. As the library has it for a
    vocabulary without a decoder, the bytes are those of the tokens' own spellings, with a space between two. With `plain` they are the
    bytes that the spellings stand for, and word ends become spaces.
    """

    def __init__(self, encoder: Encoder, plain: bool = False):
        self.raw, self.machine = _token_bytes(encoder, plain), codecs.getincrementaldecoder("utf-8")("replace")
        self.skip = 0 if plain else 1  # no space before the first token

    def feed(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        if raw and self.skip:
            raw, self.skip = raw[self.skip :], 0
        return self.machine.decode(raw)

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


def _token_bytes(encoder: Encoder, plain: bool) -> list[bytes]:
    """The bytes of every token, made once for an encoder."""
    made = encoder.__dict__.setdefault("token_bytes", {})
    if plain not in made:
        value = {c: b for b, c in enumerate(byte_alphabet())}
        own = lambda t: t.encode() if t in encoder.special else bytes(value[c] for c in t.removesuffix(END)) + (b" " if t.endswith(END) else b"")
        made[plain] = [own(t) if plain else f" {t}".encode() for t in encoder.tokens]
    return made[plain]


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", id_name: str = "doc_id") -> DataFrame:
    """The token ids of each text as an array, and the digest of what they decode to; one pass, no shuffle."""
    made: list[Encoder] = []

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Encoder(path))
        ids, decoded = [], []
        for text in batch.column(1).to_pylist():
            own, digest, decoder = [], hashlib.sha256(), Decoder(made[0])
            for piece in made[0].ids_text(text):
                new = list(map(int, piece.split(" ")))
                own += new
                digest.update(decoder.feed(new).encode())
            digest.update(decoder.finish().encode())
            ids.append(own)
            decoded.append(digest.hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.list_(pa.int32())), pa.array(decoded, type=pa.string())], names=[id_name, "token_ids", "decoded_sha256"])

    rows = columns(df, doc_id=id_col, text=text_col)
    return map_texts(rows, part, f"{id_name} {rows.schema['doc_id'].dataType.simpleString()}, token_ids array<int>, decoded_sha256 string")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of each text's ids and of what they decode to; one pass, no shuffle."""
    made: list[Encoder] = []

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Encoder(path))
        encoder, rows = made[0], []
        for text in batch.column(1).to_pylist():
            ids_hash, text_hash, decoder, n = hashlib.sha256(), hashlib.sha256(), Decoder(encoder), 0
            for piece in encoder.ids_text(text):
                ids_hash.update((" " + piece if n else piece).encode())
                ids = list(map(int, piece.split(" ")))
                n += len(ids)
                text_hash.update(decoder.feed(ids).encode())
            text_hash.update(decoder.finish().encode())
            rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
        n, ids, text = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, type=pa.int64()), pa.array(ids), pa.array(text)], names=[x.split()[0] for x in RESULT.split(", ")])

    return map_texts(columns(df, doc_id=id_col, text=text_col), part, with_own_id(RESULT, df, id_col))

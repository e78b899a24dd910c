"""Byte-level BPE through sentencepiece.

A rank file's vocabulary is serialised as a sentencepiece BPE model, with no training: each byte becomes
one printable letter, each token the piece of its bytes' letters, scored by its negative rank, and
normalisation is the identity. Merging by best score is then merging by lowest rank. Texts are cut by the
vocabulary's pattern; a pre-token that is itself a token is that token, as in rank-based encoders, and any
other is encoded as pieces. Decoding maps pieces back to bytes.

Defined results: null text is the empty text, with no ids. Null or repeated ids, ties and further columns
don't matter, as rows are handled one by one. Very long pre-tokens are handled whole.
"""

from __future__ import annotations

import base64
import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import held, with_results

#: One letter for each byte; none is white space or means anything to sentencepiece.
LETTERS = [chr(0x4E00 + b) for b in range(256)]

#: Letters and digits of Unicode versions newer than the rank-based encoder's tables: signs to it, so signs here.
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 "
    "16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 "
    "1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 "
    "1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, bytearray()  # negative numbers in two's complement
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, value) -> bytes:
    """One protocol-buffer field: bytes and strings by length, floats in 4 bytes, the rest as varints."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, (bytes, str)):
        raw = value.encode() if isinstance(value, str) else value
        return _varint(number << 3 | 2) + _varint(len(raw)) + raw
    return _varint(number << 3) + _varint(int(value))


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A ModelProto with the pieces of a rank file; piece i+1 is the token of the i-th lowest rank, 0 is unknown."""
    out = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, "".join(LETTERS[b] for b in token)) + _field(2, -float(rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder; remembers up to ``most`` pre-tokens, then starts afresh."""

    def __init__(self, path: str, pattern: str, most: int = 300_000):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.order = sorted(self.ranks.values())
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        spans = [[int(x, 16) for x in r.split("-")] for r in NEWER.split()]
        self.newer = regex.compile("[" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in spans) + "]")
        self.pattern, self.most = regex.compile(pattern), most
        self.known: dict[str, tuple[int, ...]] = {}
        self.letters = {b: letter for b, letter in enumerate(LETTERS)}

    def _one(self, raw: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        return tuple(self.order[p - 1] for p in self.sp.encode(raw.decode("latin-1").translate(self.letters)))

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if text.isascii() or not self.newer.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.newer.sub("\u00a7", text))]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for part in self.split(text or ""):
            got = known.get(part)
            if got is None:
                if len(known) >= self.most:
                    known.clear()
                got = self._one(part.encode())
                if len(part) < 200:
                    known[part] = got
            out += got
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _loaded(path: str, pattern: str) -> ByteBpe:
    """One encoder for each worker process."""
    return held(("byte_bpe", path, pattern), lambda: ByteBpe(path, pattern))


def encode_udf(path: str, pattern: str):
    """Text column to array of ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        bpe = _loaded(path, pattern)
        return pa.array([bpe.encode(t.as_py()) for t in texts], pa.list_(pa.int32()))

    return encode


def decode_udf(path: str, pattern: str):
    """Array of ids to bytes; a null array to none."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        bpe = _loaded(path, pattern)
        return pa.array([bpe.decode(x.as_py() or ()) for x in lists], pa.binary())

    return decode


def digests_udf(path: str, pattern: str):
    """Text column to (n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids that came out."""

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def digests(texts: pa.Array) -> pa.Array:
        from hashlib import sha256

        bpe, out = _loaded(path, pattern), []
        for t in texts:
            ids = bpe.encode(t.as_py())
            out.append((len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(bpe.decode(ids)).hexdigest()))
        n, i, d = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"]
        )

    return digests


def encoded(docs, path: str, pattern: str, text: Column | str = "text", into: str = "ids"):
    """docs with the ids of each text; a column of docs that has the result's name gets ``_given`` behind its own."""
    return with_results(docs, {into: encode_udf(path, pattern)(text if isinstance(text, Column) else F.col(text))})

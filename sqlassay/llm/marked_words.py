"""SentencePiece ids and decoded texts from a table of distinct marked words.

A marked word is a run of whitespace markers with what follows it up to the next marker. Where
no piece has a marker behind another character, no merge reaches from one marked word into the
next, so a text's ids are those of its marked words in turn. A task keeps a table of the
distinct marked words of its texts. A text becomes their numbers, by position; words that the
table lacks are segmented together, once each; ids and decoded words are taken by number.

Each task has a table of its own. One table of all words, filled by a distinct() and joined
back, would save half of the segmentations, but has to move a quarter of all words twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from .tokens import release, text_blocks

MARKER = "▁"
#: A marked word, with blanks for markers.
MARKED = re.compile(" +[^ ]*")
_START = re.compile("(?<! ) ")
#: Bytes of texts taken together, and characters of a part of a very long text.
BLOCK = 2_000_000
#: Words of a table, at about 200 bytes each; beyond that all are forgotten, and the next block starts a new one.
TABLE = 400_000
COLUMNS = ["doc_id", "n_tokens", "ids", "decoded"]
_models: dict = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def model(path: str):
    """The model of a file; one in which merges could cross markers is refused."""
    import sentencepiece

    if path not in _models:
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(MARKER in p.lstrip(MARKER) for p in map(m.id_to_piece, range(m.get_piece_size()))):
            raise ValueError("a piece of this model crosses a whitespace marker")
        probe = " a  ﬁ　́ "
        if m.normalize(probe) != MARKER + probe.replace(" ", MARKER):
            raise ValueError("this model changes texts before it marks their blanks")
        _models[path] = m
    return _models[path]


def parts(text: str, limit: int = BLOCK) -> Iterator[list[str]]:
    """The marked words of a text, a very long text's in several lists."""
    marked = f" {text}".replace(MARKER, " ") if text else ""
    a = 0
    while a < len(marked):
        cut = _START.search(marked, a + limit)
        b = cut.start() if cut else len(marked)
        yield MARKED.findall(marked, a, b)
        a = b


class WordTable:
    """Distinct marked words by number, with their ids and what they decode to."""

    def __init__(self, path: str, most: int = TABLE):
        self.model, self.most = model(path), most
        # behind these a word is decoded as it stands inside a text
        self.front = self.model.encode("a")
        self.skip = len(self.model.decode(self.front))
        # an empty text gets no ids, a lone marker has one: the last of "a "
        self.lone = self.model.encode("a ")[len(self.front) :]
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.decoded: list[str] = []
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1, np.int64)

    def _learn(self) -> None:
        """Segment the words that have a number and no ids yet."""
        new = list(islice(self.number, len(self.decoded), None))
        # the library puts the first marker before a text itself
        found = [x or self.lone for x in self.model.encode([w[1:] for w in new], num_threads=1)]
        said = (t[self.skip :] for t in self.model.decode([self.front + x for x in found], num_threads=1))
        self.decoded += [w if w == t else t for w, t in zip(new, said)]
        ends = self.first[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        self.first = np.concatenate([self.first, ends])
        while self.first[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[ends[0] - len(found[0]) : ends[-1]] = np.fromiter((i for x in found for i in x), np.uint32)

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Of the words of a block: all their ids, how many each has, and what each decodes to."""
        if len(self.number) > self.most:
            self._clear()
        number = self.number
        at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        if len(number) > len(self.decoded):
            self._learn()
        many = self.first[at + 1] - self.first[at]
        ends = np.cumsum(many)
        flat = self.ids[np.repeat(self.first[at] - ends + many, many) + np.arange(ends[-1] if len(at) else 0)]
        return flat, many, [self.decoded[k] for k in at.tolist()]


def _encoded(texts: list[str], table: WordTable, limit: int) -> Iterator[tuple[int, bytes, str]]:
    """n_tokens, ids and decoded of each text; one text longer than ``limit`` goes through part by part."""
    begin, end = table.model.bos_id(), table.model.eos_id()
    if len(texts) == 1:
        ids, said = [np.array([begin], "<u4").tobytes()], []
        for words in parts(texts[0], limit):
            flat, _, decoded = table.look_up(words)
            ids.append(flat.astype("<u4", copy=False).tobytes())
            said.append("".join(decoded))
        ids.append(np.array([end], "<u4").tobytes())
        whole, text = b"".join(ids), "".join(said)
        # the first marker is the library's own
        yield len(whole) // 4, whole, text.removeprefix(" ")
        return
    found = [next(parts(t, len(t) + 1), []) for t in texts]
    flat, many, decoded = table.look_up([w for words in found for w in words])
    word = np.cumsum([0, *map(len, found)])
    token = np.concatenate([[0], np.cumsum(many)])[word]
    # the end of a text, and the beginning of the next, lie where one passes into the other
    data = np.insert(flat, np.repeat(token, 2)[1:-1], np.tile([begin, end], len(texts))).astype("<u4").tobytes()
    token = 4 * (token + 2 * np.arange(len(token)))
    for k in range(len(texts)):
        yield int(token[k + 1] - token[k]) // 4, data[token[k] : token[k + 1]], "".join(decoded[word[k] : word[k + 1]]).removeprefix(" ")


def encode_documents(docs: DataFrame, path: str | None = None, block: int = BLOCK, most_words: int = TABLE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit, begin and end id included), decoded.

    Ids and decoded text are those of the sentencepiece library for the whole text; null counts
    as empty. Repeated rows are encoded as often as they occur. A word without blanks is
    segmented whole, however long. A very long text goes through in parts of ``block``
    characters, cut before a marked word, and its ids and decoded text are put together at the end, at
    about four times its size. Tables hold ``most_words`` words and those of a block at
    most. An empty table gives no rows; other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        words = WordTable(path, most_words)
        for batch in batches:
            for a, b, texts in text_blocks(batch, block):
                rows = zip(*_encoded(texts, words, block))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *map(pa.array, rows, (pa.int64(), pa.binary(), pa.string()))], COLUMNS)

    ship(docs.sparkSession)
    path, kind = path or model_path(), dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary, decoded string")

"""SentencePiece encoding by a prefix table, and decoding.

A piece model of merge type joins, again and again, the two neighbouring pieces whose union ranks
best. Which ids come out can be had without merging: two pieces may stand side by side only if the
merges that make them never join across their boundary, and every prefix of a string has exactly one
last piece that fits to the last piece of what is before it. An automaton over all pieces names the
pieces that end at each place; the one that fits is written into the table; the ids are then read
from the table backwards. A character that the model does not have becomes its bytes.
"""

from __future__ import annotations

import array
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a space in normalised text and in pieces.
SPACE = "▁"
#: A worker remembers the ids of twice so many words at most, none longer than REMEMBERED_CHARS, and as many pairs that fit or do not.
REMEMBERED = 1 << 19
REMEMBERED_CHARS = 48
#: Characters of a text that are split at once.
WINDOW = 1 << 22
#: Ids, or bytes of text, that leave a task at once.
OUT = 1 << 20
_MODELS: dict = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """A model file of merge type with byte fallback; raises ValueError for others."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [i for i in range(len(lib)) if lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)]
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in special if lib.is_byte(i)}
        order = sorted(set(range(len(lib))).difference(special), key=lambda i: -lib.get_score(i))
        pieces = [lib.id_to_piece(i) for i in order]
        scores = {s: n for n, s in enumerate(sorted({lib.get_score(i) for i in order}, reverse=True))}
        #: Pieces go by their number in the order of scores; equal scores are of one level, and there the left of two merges comes first.
        self.ids, self.number, self.level = order, {p: n for n, p in enumerate(pieces)}, [scores[lib.get_score(i)] for i in order]
        single = {p for p in pieces if len(p) == 1}
        if len(self.bytes) != 256 or not set().union(*pieces) <= single:
            raise ValueError("not a model with byte fallback and a piece for each character")
        self.pieces = pieces
        self.levels = {p: self.level[n] for n, p in enumerate(pieces)}
        self.first, self.second = [-1] * len(pieces), [-1] * len(pieces)
        automaton = ahocorasick.Automaton()
        for r, piece in enumerate(pieces):
            made = self._merged(piece)
            if made:  # (others are never made, so they are no matches)
                self.first[r], self.second[r] = made
                automaton.add_word(piece, (len(piece), r))
        automaton.make_automaton()
        self.matches = automaton.iter
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece goes on over a space")
        # no piece goes on over a boundary of these parts
        known = "".join(map(re.escape, sorted(single - {SPACE})))
        self.parts = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|[^{known}{SPACE}]", re.DOTALL).findall
        self.known, self.words, self.older, self.fitting = single, {}, {}, {}

    def _merged(self, piece: str) -> tuple[int, int] | None:
        """The two parts that merging joins last into ``piece``: (-1, -1) for a character, None where merging ends otherwise."""
        parts, last, at = list(piece), (-1, -1), -1
        while len(parts) > 1:
            best, i = min(((self.levels.get(a + b, len(self.pieces)), i) for i, (a, b) in enumerate(pairwise(parts))))
            if best == len(self.pieces):
                return None
            if best < at:
                raise ValueError(f"the merges of {piece!r} do not come in the order of their scores")
            last, at = (self.number[parts[i]], self.number[parts[i + 1]]), best
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last

    def fits(self, left: int, right: int) -> bool:
        """Whether merging never joins over the boundary of the two pieces (given by number).

        Goes back through their merges, the latest first. While the parts a and b face each other, the
        union of a and b must not come before the merge that ends this state; of equal merges the left is first.
        """
        a, b, until = left, right, len(self.pieces)
        while True:
            joined = self.levels.get(self.pieces[a] + self.pieces[b], until)
            if joined < until:
                return False
            last_a, last_b = self.first[a] >= 0, self.first[b] >= 0
            if last_a and (not last_b or self.level[a] > self.level[b]):
                until, a = self.level[a], self.second[a]
            elif last_b:  # what the right piece does later may tie with the boundary, which is further left
                until, b = self.level[b] + 1, self.first[b]
            else:
                return True

    def _encode_part(self, part: str) -> tuple[int, ...]:
        if part[0] not in self.known:
            return tuple(self.bytes[x] for x in part.encode())
        table, fitting, n, at = [0] * len(part), self.fitting, len(self.pieces), -1
        for end, (length, piece) in self.matches(part):
            if end == at:
                continue
            if length <= end:
                before = table[end - length]
                ok = fitting.get(before * n + piece)
                if ok is None:
                    if len(fitting) >= REMEMBERED:
                        fitting.clear()
                    ok = fitting[before * n + piece] = self.fits(before, piece)
                if not ok:
                    continue
            table[end], at = piece, end
        out, end = [], len(part)
        while end:
            piece = table[end - 1]
            out.append(self.ids[piece])
            end -= len(self.pieces[piece])
        out.reverse()
        return tuple(out)

    def _encode_run(self, run: str) -> tuple[int, ...]:
        """The ids of any part of a text that begins where no piece goes on."""
        return tuple(chain.from_iterable(map(self._encode_part, self.parts(run))))

    def _word(self, key: str) -> tuple[int, ...]:
        """The ids of a word after one space, or of what follows the space that begins ``key``: from the older of the remembered words or made now."""
        own = self.older.pop(key, None)
        if own is None:
            word = key[1:] if key[0] == SPACE else key
            line = word.find("\n", 1) if "\n" not in self.known else -1
            if line > 0:  # the end of a line and the start of the next are better remembered apart
                head, rest = key[: line - len(word)], SPACE + word[line:]
                return (self.words.get(head) or self._word(head)) + (self.words.get(rest) or self._word(rest))
            run = word if key[0] == SPACE else SPACE + word
            own = self._encode_part(run) if self.known.issuperset(run) else self._encode_run(run)
        if len(key) <= REMEMBERED_CHARS:
            if len(self.words) >= REMEMBERED:
                self.older, self.words = self.words, {}
            self.words[key] = own
        return own

    def encode(self, text: str) -> array.array:
        ids, normal, at = array.array("i"), self.library.normalize(text), 0
        while at < len(normal):
            end = at + WINDOW
            while end < len(normal) and not (normal[end] == SPACE != normal[end - 1]):
                end += 1
            head, *words = normal[at:end].split(SPACE)
            if head:
                ids.extend(self._encode_run(head))
            spaces = 1
            for word in words:
                if not word:
                    spaces += 1
                elif spaces == 1:
                    ids.extend(self.words.get(word) or self._word(word))
                else:
                    ids.extend(self._encode_run(SPACE * spaces + word))
                    spaces = 1
            if spaces > 1:
                ids.extend(self._encode_run(SPACE * (spaces - 1)))
            at = end
        return ids


def _model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text; more columns are ignored) to (doc_id, ids), a row for each row.

    Null and empty texts have no ids. Any id type and null ids are handed through; repeated rows are
    encoded alike; an empty table gives no rows. Texts are encoded whole, whatever their length.
    """
    path = model or default_model()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(path)
        for batch in batches:
            ids, ends, begin = array.array("i"), array.array("i", [0]), 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text:
                    ids.extend(pieces.encode(text))
                ends.append(len(ids))
                if len(ids) >= OUT or i + 1 == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, i + 1 - begin), lists], ["doc_id", "ids"])
                    ids, ends, begin = array.array("i"), array.array("i", [0]), i + 1

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` with its column ids (array of int) replaced by the text that the library decodes from them; null ids count as none. Other columns are handed through."""
    path = model or default_model()
    kept = [c for c in encoded.columns if c != "ids"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            texts, begin, size, last = [], 0, 0, batch.num_columns - 1
            for i, ids in enumerate(batch.column(last)):
                ids = ids.values
                texts.append(library.decode(ids.to_numpy(zero_copy_only=False).tolist()) if ids else "")
                size += len(texts[-1])
                if size >= OUT or i + 1 == batch.num_rows:
                    columns = [c.slice(begin, i + 1 - begin) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*kept, "text"])
                    texts, begin, size = [], i + 1, 0

    fields = [f for f in encoded.schema.fields if f.name != "ids"]
    return encoded.select(*kept, "ids").mapInArrow(decode, T.StructType([*fields, T.StructField("text", T.StringType())]))


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, decoded again, and both digested. Cases as in ``encode_pieces``."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    encoded = encode_pieces(docs, model).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "ids")
    return decode_pieces(encoded, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))

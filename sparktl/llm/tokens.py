"""Whole-text encoding with the tokenizers library, many texts at a time.

The vocabularies split a text at white space before any merge, so the pieces between the places
where a visible character meets an ASCII blank can be encoded apart. Arrow splits a stretch of texts
into pieces and numbers the distinct ones; only pieces that the worker does not know are encoded, in a
few calls of the library, and the ids of all texts are gathered with numpy. Texts with runs of blanks
or other white space (tab, no-break space and the like) are encoded as a whole.

Memory: a stretch holds up to STRETCH bytes of text (one longer text is a stretch of its own), and a
worker keeps the ids of at most KNOWN bytes of pieces between stretches, only those that came twice.

Defined results: a null text counts as empty and has no ids but the end id; special strings in a text
are ordinary text; texts are never cut before encoding; columns beside the two named ones are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from sparktl.llm.common import held

STRETCH = 4 << 20
KNOWN = 6 << 20
#: White space that the libraries may class differently from the four plain blanks.
ODD = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Where blanks count, texts with these are not cut at blanks.
MIXED = r"  | \n|\n |\n\n|\t|\r|\A[ \n]|[ \n]\z"
#: Punctuation that can follow a word; a run of it is one unit of either vocabulary's pattern.
TAIL = '.,!?;:%&$#*|()[]"'
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = rf'\A[{LATIN}]+[.,!?;:%&$#*|()\[\]"]*\z'
#: How byte-level vocabularies write the bytes that are not printable: in order, from U+0100 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTED)}
WRITTEN = {chr(c): "".join(chr(BYTES.get(b, b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}
UNIT_MARK = chr(BYTES[2])


def tokenizer(file: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers

    out = Tokenizer.from_file(public_tokenizers.path(file))
    out.encode_special_tokens = True
    return out


class Ids:
    """Runs of ids: run k is flat[start[k] : start[k] + size[k]]."""

    def __init__(self, flat: np.ndarray, size: np.ndarray, start: np.ndarray | None = None):
        self.flat, self.size = flat, size.astype("<i8")
        self.start = np.cumsum(self.size) - self.size if start is None else start

    @classmethod
    def none(cls) -> Ids:
        return cls(np.zeros(0, "<u4"), np.zeros(0, "<i8"))

    @classmethod
    def joined(cls, parts: list[Ids]) -> Ids:
        """The runs of all parts, numbered on."""
        at = np.cumsum([0] + [len(p.flat) for p in parts])
        return cls(np.concatenate([p.flat for p in parts]), np.concatenate([p.size for p in parts]), np.concatenate([p.start + a for p, a in zip(parts, at)]))

    def gather(self, runs: np.ndarray) -> np.ndarray:
        return gathered(self.flat, self.start[runs], self.size[runs])

    def take(self, runs: np.ndarray) -> Ids:
        return Ids(self.gather(runs), self.size[runs])


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    begin = np.cumsum(size)
    total = int(begin[-1]) if len(begin) else 0
    at = np.repeat((start - begin + size).astype("<i4" if len(flat) + total < 1 << 31 else "<i8"), size)
    at += np.arange(total, dtype=at.dtype)
    return flat[at]


class Encoder:
    """encode(text) gives the bytes of all ids of a text, encode_all those of many texts.

    blanks: whether the vocabulary keeps white space; one that drops it is taken to lower the case too.

    New pieces go to the library with a mark between them that makes one token of its own and stands in
    none of them; the ids are cut at the mark. A word of Latin letters, with or without punctuation
    behind it, needs no splitting by the library: its letters are one unit of the vocabulary's pattern
    and the punctuation another, so the library's model takes the units directly.

    Where blanks count, a piece is a word, which follows a blank, or a line's end and a word.
    """

    def __init__(self, file: str, blanks: bool):
        self.library, self.blanks, self.mark = tokenizer(file), blanks, "\n" if blanks else " \x02 "
        self.units = Tokenizer(self.library.model)
        self.units.pre_tokenizer = CharDelimiterSplit("\n")
        self.whole = f"{ODD}|{MIXED}" if blanks else ODD
        self.cuts = self.raw(self.mark.strip(" "))[0], self.units.encode(UNIT_MARK, add_special_tokens=False).ids[0]
        self.line = self.raw("\n") if blanks else np.zeros(0, "<u4")
        self.tails: dict[str, np.ndarray] = {"": np.zeros(0, "<u4")}
        self.forget()

    def forget(self) -> None:
        self.known, self.known_ids = pa.array([], pa.string()), Ids.none()

    def raw(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def at_marks(self, ids: list[int], count: int, cut: int) -> Ids:
        flat = np.array(ids, "<u4")
        marks = np.flatnonzero(flat == cut)
        assert len(marks) == count - 1
        start = np.append(0, marks + 1)
        return Ids(flat, np.append(marks, len(flat)) - start, start)

    def bodies(self, words: pa.StringArray, lead: str) -> Ids:
        """Words of Latin letters; lead stands before each in the vocabulary's writing."""
        if not len(words):
            return Ids.none()
        text = "\n".join(words.to_numpy(zero_copy_only=False).tolist())
        if not text.isascii():
            for c in set(text) & WRITTEN.keys():
                text = text.replace(c, WRITTEN[c])
        text = lead + text.replace("\n", f"\n{UNIT_MARK}\n{lead}")
        return self.at_marks(self.units.encode_batch_fast([text], add_special_tokens=False)[0].ids, len(words), self.cuts[1])

    def others(self, words: pa.StringArray, lead: str) -> Ids:
        """Pieces of any characters but the blanks that texts are cut at."""
        words, mark = words.to_numpy(zero_copy_only=False).tolist(), self.mark.strip(" ")
        joint = [x for x in words if x and mark not in x]
        found = []
        if joint:
            found.append(self.at_marks(self.library.encode_batch_fast([self.mark.join([lead + x for x in joint])], add_special_tokens=False)[0].ids, len(joint), self.cuts[0]))
        if len(joint) == len(words):
            return found[0] if found else Ids.none()
        alone = [self.raw(lead + x) if x else np.zeros(0, "<u4") for x in words if not x or mark in x]
        found.append(Ids(np.concatenate(alone), np.array([len(x) for x in alone])))
        one, two = iter(range(len(joint))), iter(range(len(joint), len(words)))
        return Ids.joined(found).take(np.array([next(one if x and mark not in x else two) for x in words], "<i8"))

    def fresh(self, new: pa.StringArray) -> Ids:
        """The ids of distinct pieces."""
        n = len(new)
        lines = pc.starts_with(new, "\n") if self.blanks else pa.array(np.zeros(n, bool))
        core = pc.if_else(lines, pc.utf8_slice_codeunits(new, 1), new) if self.blanks else new
        simple = pc.match_substring_regex(core, WORD)
        is_line, is_simple = (x.to_numpy(zero_copy_only=False) for x in (lines, simple))
        # every piece is three runs: a line's end, letters, punctuation
        parts = [Ids(self.line, np.array([len(self.line)])), Ids(np.zeros(0, "<u4"), np.zeros(1))]
        runs, at = np.ones((n, 3), "<i8"), 2
        runs[is_line, 0] = 0
        for line in (False, True) if self.blanks else (False,):
            mine = np.flatnonzero(is_simple & (is_line == line))
            if len(mine):
                one = core.take(pa.array(mine))
                body = pc.ascii_rtrim(one, TAIL)
                body = (body if self.blanks else pc.utf8_lower(body)).dictionary_encode()
                parts.append(self.bodies(body.dictionary, "Ġ" if self.blanks and not line else ""))
                runs[mine, 1] = at + body.indices.to_numpy()
                at += len(body.dictionary)
                tailed = np.flatnonzero(pc.match_substring_regex(one, rf"[^{LATIN}]\z").to_numpy(zero_copy_only=False))
                tail = pc.replace_substring_regex(one.take(pa.array(tailed)), rf"\A[{LATIN}]+", "").dictionary_encode()
                for x in tail.dictionary.to_pylist():
                    if x not in self.tails:
                        self.tails[x] = self.raw(x)
                found = [self.tails[x] for x in tail.dictionary.to_pylist()]
                if found:
                    parts.append(Ids(np.concatenate(found), np.array([len(x) for x in found])))
                    runs[mine[tailed], 2] = at + tail.indices.to_numpy()
                    at += len(found)
            mine = np.flatnonzero(~is_simple & (is_line == line))
            if len(mine):
                parts.append(self.others(core.take(pa.array(mine)), " " if self.blanks and not line else ""))
                runs[mine, 1] = at + np.arange(len(mine))
                at += len(mine)
        every = Ids.joined(parts)
        return Ids(every.gather(runs.ravel()), every.size[runs].sum(1))

    def ids_of(self, pieces: pa.StringArray, count: np.ndarray) -> Ids:
        """The ids of distinct pieces, which come count times here."""
        known = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(known < 0)
        if not len(new):
            return self.known_ids.take(known)
        words = pieces.take(pa.array(new))
        found = self.fresh(words)
        runs = known.astype("<i8")
        runs[new] = len(self.known) + np.arange(len(new))
        every = Ids.joined([self.known_ids, found])
        again = np.flatnonzero(count[new] > 1)
        if len(again):
            if self.known.nbytes + self.known_ids.flat.nbytes + 16 * len(self.known) > KNOWN:
                # those that came twice here are kept; the rest comes back as it is met
                again = np.flatnonzero(count > 1)
                self.known, self.known_ids = pieces.take(pa.array(again)), every.take(runs[again])
            else:
                self.known = pa.concat_arrays([self.known, words.take(pa.array(again))])
                more = Ids.joined([self.known_ids, found.take(again)])
                self.known_ids = more
        return Ids(every.flat, every.size[runs], every.start[runs])

    def stretch(self, texts: pa.StringArray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each followed by end; how many ids each has)."""
        n = len(texts)
        texts = texts.fill_null("")
        whole = np.flatnonzero(pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False))
        plain = texts
        if len(whole):
            mask = np.zeros(n, bool)
            mask[whole] = True
            plain = pc.if_else(pa.array(mask), "", texts)
        if self.blanks:
            # the first word is taken as one behind a line's end, whose id is then dropped
            plain = pc.binary_join_element_wise("\n", pc.replace_substring(plain, "\n", " \n"), "")
        else:
            plain = pc.ascii_lower(pc.replace_substring(plain, "\n", " "))
        lists = pc.split_pattern(plain, " ")
        named = lists.flatten().dictionary_encode()
        codes = named.indices.to_numpy()
        ids = self.ids_of(named.dictionary, np.bincount(codes, minlength=len(named.dictionary)))
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        alone = [self.raw(texts[int(k)].as_py()) for k in whole]
        every = Ids.joined([ids, Ids(end, np.array([len(end)])), *[Ids(x, np.array([len(x)])) for x in alone]])
        runs = np.insert(codes.astype("<i8"), bounds[1:], len(ids.size))
        last = bounds[1:] + np.arange(n)
        start, size = every.start[runs], every.size[runs]
        if self.blanks:
            first = bounds[:-1] + np.arange(n)
            start[first] += len(self.line)
            size[first] -= len(self.line)
        # a whole text stands in the place of its first piece, which is empty; it has one piece
        for k, text in enumerate(whole):
            place = last[text] - 1
            start[place], size[place] = every.start[len(ids.size) + 1 + k], every.size[len(ids.size) + 1 + k]
        return gathered(every.flat, start, size), np.add.reduceat(size, np.append(0, last[:-1] + 1)) if n else np.zeros(0, "<i8")

    def encode_all(self, texts: pa.StringArray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, counts) of stretches of the texts."""
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRETCH, "right")))
            yield at, *self.stretch(texts.slice(at, stop - at), end)
            at = stop

    def encode(self, text: str | None) -> bytes:
        return self.stretch(pa.array([text], pa.string()), np.zeros(0, "<u4"))[0].astype("<u4").tobytes()


def binaries(ids: np.ndarray, counts: np.ndarray) -> pa.BinaryArray:
    offsets = np.append(0, np.cumsum(counts * 4)).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def id_runs(df: DataFrame, file: str, end_id: int, blanks: bool, make, schema: str, id_column: str = "doc_id") -> DataFrame:
    """make(ids, rows, counts), a record batch of the schema, for stretches of df's rows in their order.

    ids: all ids of the stretch's texts, each text's followed by end_id; rows: the id column; counts: of ids by text.
    """
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held((file, blanks), lambda: Encoder(file, blanks))
        for batch in batches:
            for at, ids, counts in encoder.encode_all(batch.column(1), end):
                yield make(ids, batch.column(0).slice(at, len(counts)), counts)
        pa.default_memory_pool().release_unused()

    return df.select(df[id_column].alias("doc_id"), "text").mapInArrow(run, schema)


def encoded(df: DataFrame, file: str, end_id: int, blanks: bool, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, ids binary): the ids of every whole text and then end_id, in the order of df's rows."""

    def make(ids: np.ndarray, rows: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows, binaries(ids, counts)], ["doc_id", "ids"])

    return id_runs(df, file, end_id, blanks, make, "doc_id bigint, ids binary", id_column)

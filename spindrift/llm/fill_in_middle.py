"""Fill-in-middle transformation over UTF-8 bytes with a sparse exception index.

Cuts are drawn in code points but texts are cut as bytes. Only characters of more than one byte
are recorded: their code-point index and the bytes they have in excess of one. ``searchsorted``
counts the excess in front of a cut; a text without such characters has no entries, and its cuts
are their own byte offsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 texts, those from this number on stay plain; of the others, those below SPM_SHARE are spm.
PLAIN_FROM, SPM_SHARE = 90, 20
#: Bytes of text that are indexed together; one longer text is indexed by itself.
SLICE_BYTES = 4 << 20
_OWN = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256")


@dataclass(frozen=True)
class ExceptionIndex:
    """Characters of several bytes in some consecutive texts: ``at`` is the code-point index (counted
    over all of the texts) and ``excess`` the running sum of bytes beyond one, with a leading zero."""

    at: np.ndarray
    excess: np.ndarray
    first_byte: np.ndarray
    first_point: np.ndarray

    @classmethod
    def build(cls, data: np.ndarray, bounds: np.ndarray) -> ExceptionIndex:
        """``data`` are the bytes of the texts, ``bounds`` their starts and the end of the last."""
        byte = np.flatnonzero(data >= 0xC0)
        lead = data[byte]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        excess = np.zeros(len(byte) + 1, dtype=np.int64)
        np.cumsum(extra, out=excess[1:])
        return cls(byte - excess[:-1], excess, bounds, bounds - excess[np.searchsorted(byte, bounds)])

    def points(self) -> np.ndarray:
        """Code points of each text."""
        return np.diff(self.first_point)

    def byte_of(self, text: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Byte offset, over all of the texts, of a cut after ``cut`` code points of ``text``."""
        point = self.first_point[text] + cut
        return point + self.excess[np.searchsorted(self.at, point, side="left")]


def draws(ids: list) -> np.ndarray:
    """The four unsigned numbers that a document's id draws; a missing id draws as an empty one."""
    digests = b"".join(hashlib.sha256(b"1:" + (b"" if i is None else str(i).encode())).digest()[:16] for i in ids)
    return np.frombuffer(digests, dtype=">u4").reshape(-1, 4).astype(np.int64)


def assemble(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == PSM:
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    if form == SPM:
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return b"".join((prefix, middle, suffix))


def restore(form: str, output: bytes) -> bytes:
    """The text of an output. Markers can't be mistaken: texts that hold one stay plain, and no
    end of a part makes a marker together with the start of the next marker."""
    if form == PLAIN:
        return output
    inner = SUFFIX if form == PSM else PREFIX
    one, _, rest = output[len(PREFIX) :].partition(inner)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == PSM else two + middle + one


def _ranges(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, side="right")) - 1)
        yield first, last
        first = last


def _transform(names: list[str], with_text: bool, with_digests: bool):
    def transform(batches):
        for b in batches:
            texts = b.column(1)
            bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int32)
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
            for first, last in _ranges(bounds):
                low, high = int(bounds[first]), int(bounds[last])
                index = ExceptionIndex.build(data[low:high], bounds[first : last + 1].astype(np.int64) - low)
                held, n = data[low:high].tobytes(), index.points()
                h = draws(b.column(0).slice(first, last - first).to_pylist())
                one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
                before, after = np.minimum(one, two), np.maximum(one, two)
                which = np.arange(last - first)
                cuts = np.column_stack([index.first_byte[:-1], index.byte_of(which, before), index.byte_of(which, after), index.first_byte[1:]])
                drawn = np.where(h[:, 2] % 100 >= PLAIN_FROM, 0, np.where(h[:, 3] % 100 < SPM_SHARE, 2, 1)).tolist()
                forms, outputs, made, back = [], [], [], []
                for (a, p, m, z), kind in zip(cuts.tolist(), drawn, strict=True):
                    text = held[a:z]
                    plain = not text or PREFIX in text or SUFFIX in text or MIDDLE in text
                    form = PLAIN if plain else (PLAIN, PSM, SPM)[kind]
                    output = text if form == PLAIN else assemble(form, held[a:p], held[p:m], held[m:z])
                    forms.append(form)
                    if with_text:
                        outputs.append(output)
                    if with_digests:
                        made.append(hashlib.sha256(output).hexdigest())
                        back.append(hashlib.sha256(restore(form, output)).hexdigest())
                cut = pa.array([f == PLAIN for f in forms], pa.bool_()).to_numpy(zero_copy_only=False)
                columns = [b.column(0).slice(first, last - first), pa.array(n), pa.array(forms, pa.string())]
                columns += [pa.array(x.astype(np.int64), mask=cut) for x in (before, after - before)]
                columns += [pa.array(outputs, pa.binary())] if with_text else []
                columns += [pa.array(made, pa.string()), pa.array(back, pa.string())] if with_digests else []
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return transform


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, with_digests: bool = False) -> DataFrame:
    """``<id_col>``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and, if asked for, ``output``
    and the digests ``output_sha256`` and ``restored_sha256``: one row per input row.

    A text of n code points is cut twice, at places drawn from its id; the form is ``psm``, ``spm``
    or ``plain``. Null texts count as empty; empty texts and texts that hold a marker are plain,
    with null ``prefix_chars`` and ``middle_chars``. Rows don't meet, so ids and texts may repeat
    (equal ids draw equal numbers), and an id may be null (it draws as an empty string). An empty
    table gives an empty result. Other columns are ignored, whatever their names; the id's own name
    must not be one of the result's. Texts of any length are cut as bytes, in slices of about
    ``SLICE_BYTES``, without decoding them.
    """
    if id_col in _OWN:
        raise ValueError(f"{id_col} is a column of the result")
    chosen = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]
    fields += [T.StructField("output", T.BinaryType())] if with_text else []
    fields += [T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())] if with_digests else []
    schema = T.StructType([chosen.schema[0], *fields])
    made = chosen.mapInArrow(_transform(schema.names, with_text, with_digests), schema)
    return made.withColumn("output", F.col("output").cast("string")) if with_text else made

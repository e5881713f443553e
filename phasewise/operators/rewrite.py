"""Copies of read pairs with the alleles of each haplotype put in.

The overlaps come from an interval join; one Arrow UDF call rewrites many
pairs. Variants that can't be placed on a read make the whole pair unmappable;
a pair that no haplotype changes is kept as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.functions import columns as C
from phasewise.operators.interval_join import READ_BIN, interval_join
from phasewise.operators.pairs import REVERSE, mate_pairs

_OP = re.compile(r"(\d+)([MIDNSHP=X])")
#: Quality of inserted bases without neighbours, and of padding.
DEFAULT_QUALITY, PAD_QUALITY = 30, 0
#: Trimmed copies of a pair at most, and of each mate where that is exceeded.
MOST_TRIMS, MOST_TRIMS_A_SIDE = 256, 16


@dataclass(frozen=True)
class Edit:
    """A variant's span on the reference and the two alleles of the sample."""

    start: int
    stop: int
    hap1: str
    hap2: str
    ref_len: int = 0


@dataclass(frozen=True)
class Alignment:
    pos0: int
    ops: tuple[tuple[str, int], ...]

    @classmethod
    def of(cls, pos0: int, cigar: str) -> Alignment:
        return cls(pos0, tuple((op, int(n)) for n, op in _OP.findall(cigar)))

    @property
    def end(self) -> int:
        return self.pos0 + sum(n for op, n in self.ops if op in "MDN=X")

    def _steps(self) -> Iterator[tuple[str, int, int, int]]:
        """op, length, reference and query position it begins at."""
        ref, query = self.pos0, 0
        for op, n in self.ops:
            yield op, n, ref, query
            ref += n if op in "MDN=X" else 0
            query += n if op in "MIS=X" else 0

    def base(self, target: int) -> int | None:
        """Query position of the base aligned to `target`."""
        for op, n, ref, query in self._steps():
            if op in "M=X" and ref <= target < ref + n:
                return query + target - ref
        return None

    def boundary(self, target: int) -> int | None:
        """Query position before `target`: deletions give their flank, splices none, the end of the span the place behind it."""
        query_end = self.pos0, 0
        for op, n, ref, query in self._steps():
            if op in "MDN=X":
                if target < ref:
                    return None
                if target < ref + n:
                    return None if op == "N" else query if op == "D" else query + target - ref
            query_end = ref + (n if op in "MDN=X" else 0), query + (n if op in "MIS=X" else 0)
        return query_end[1] if target == query_end[0] else None

    def flank(self, target: int, left: bool) -> int | None:
        """Query position of `target`, or in a deletion that of the aligned base left or right of it."""
        exact = self.base(target)
        if exact is not None:
            return exact
        pairs = [(ref + i, query + i) for op, n, ref, query in self._steps() if op in "M=X" for i in range(n)]
        side = [q for r, q in pairs if (r < target if left else r > target)]
        return (side[-1] if left else side[0]) if side and self.pos0 <= target < self.end else None

    def shift(self, edits: Sequence[Edit], hap: int) -> int:
        """Where the read should start with the haplotype put in: variants before it or over its start move it."""
        moved = sum(len((e.hap1, e.hap2)[hap]) - e.ref_len for e in edits if e.stop <= self.pos0 or e.start < self.pos0 < e.stop)
        return max(0, self.pos0 + moved)


def spans_on_read(read: Alignment, edits: Sequence[Edit]) -> list[tuple[int, int]] | None:
    """Query span of each edit; None if one can't be placed, or if spans cross."""
    resized = any(len(a) != e.stop - e.start for e in edits for a in (e.hap1, e.hap2))
    out, before = [], 0
    for e in edits:
        if resized:
            start, stop = read.boundary(e.start), read.boundary(e.stop)
        else:
            start, last = read.base(e.start), read.base(e.stop - 1)
            stop = None if last is None else last + 1
        if start is None or stop is None or start > stop or start < before:
            return None
        out.append((start, stop))
        before = stop
    return out


def put_in(seq: str, qual: Sequence[int], spans: Sequence[tuple[int, int]], alleles: Sequence[str]) -> tuple[str, list[int]]:
    """Sequence and qualities with the alleles in place of the spans.

    A shorter allele drops qualities from its end; a longer one gets the mean
    of the stretches on both sides, cut to a whole number.
    """
    edges = [0, *(x for s in spans for x in s), len(seq)]
    bases, scores = [], []
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if i % 2 == 0:
            bases.append(seq[a:b])
            scores += qual[a:b]
            continue
        allele = alleles[i // 2]
        bases.append(allele)
        more = len(allele) - (b - a)
        scores += qual[a : min(b, a + len(allele))]
        if more > 0:
            around = [*qual[edges[i - 1] : a], *qual[b : edges[i + 2]]]
            scores += [sum(around) // len(around) if around else DEFAULT_QUALITY] * more
    return "".join(bases), scores


def haplotypes(read: Alignment, seq: str, qual: Sequence[int], edits: Sequence[Edit]) -> list[tuple[str, list[int]]] | None:
    """The read with each haplotype's alleles; None if a variant can't be placed."""
    if not edits:
        return [(seq, list(qual))] * 2
    edits = sorted(edits, key=lambda e: (e.start, e.stop))
    spans = spans_on_read(read, edits)
    if spans is None or spans[-1][1] > len(seq):
        return None
    return [put_in(seq, qual, spans, [(e.hap1, e.hap2)[h] for e in edits]) for h in (0, 1)]


def trims(delta: int, length: int) -> list[tuple[int, int]]:
    """Ways to cut `delta` surplus bases from both ends, at most half the read on each; none needed: (0, 0)."""
    if delta <= 0:
        return [(0, 0)]
    ways = [(left, delta - left) for left in range(delta + 1) if max(left, delta - left) <= length // 2]
    return ways or [(delta // 2, delta - delta // 2)]


def trimmed(seq: str, qual: Sequence[int], length: int, way: tuple[int, int]) -> tuple[str, list[int]]:
    """Cut, or padded with N of quality 0, to `length`."""
    if len(seq) > length:
        seq, qual = seq[way[0] : len(seq) - way[1]], qual[way[0] : len(qual) - way[1]]
    seq, qual = seq[:length], list(qual[:length])
    return seq + "N" * (length - len(seq)), qual + [PAD_QUALITY] * (length - len(qual))


@dataclass(frozen=True)
class Mate:
    pos0: int
    cigar: str
    seq: str
    qual: Sequence[int]
    edits: Sequence[Edit]


def pair_copies(name: str, m1: Mate, m2: Mate, indels: bool = False, max_indel: int = 50, skip_large: bool = True, tag: str = C.TAG) -> tuple[str, list[dict]]:
    """Outcome (remap, keep or unmappable) of a pair, and its copies that differ from it."""
    reads = [Alignment.of(m.pos0, m.cigar) for m in (m1, m2)]
    haps = [haplotypes(r, m.seq, m.qual, m.edits) for r, m in zip(reads, (m1, m2), strict=True)]
    if haps[0] is None or haps[1] is None:
        return "unmappable", []
    found, considered = [], False
    for h, (a, b) in enumerate(zip(*haps, strict=True)):
        if not indels:
            considered = True
            if (a[0], b[0]) != (m1.seq, m2.seq):
                found.append((a, b, (m1.pos0, m2.pos0), 0, 1, 0, 0))
            continue
        d1, d2 = len(a[0]) - len(m1.seq), len(b[0]) - len(m2.seq)
        if skip_large and max(abs(d1), abs(d2)) > max_indel:
            continue
        considered = True
        ways1, ways2 = trims(d1, len(m1.seq)), trims(d2, len(m2.seq))
        if len(ways1) * len(ways2) > MOST_TRIMS:
            ways1, ways2 = ways1[:MOST_TRIMS_A_SIDE], ways2[:MOST_TRIMS_A_SIDE]
        expected = reads[0].shift(m1.edits, h), reads[1].shift(m2.edits, h)
        for i, w1 in enumerate(ways1):
            for j, w2 in enumerate(ways2):
                x, y = trimmed(*a, len(m1.seq), w1), trimmed(*b, len(m2.seq), w2)
                if (x[0], y[0]) != (m1.seq, m2.seq):
                    found.append((x, y, expected, i << 8 | j, len(ways1) * len(ways2), d1, d2))
    if not found:
        return ("keep" if considered else "unmappable"), []
    out = []
    for nth, (x, y, expected, trim, ways, d1, d2) in enumerate(found, 1):
        parts = [m1.pos0, m2.pos0, nth, len(found), *([trim, ways, abs(d1), abs(d2)] if indels else [])]
        out.append({
            "name": name + tag + "_".join(map(str, parts)), "seq1": x[0], "qual1": _text(x[1]), "seq2": y[0], "qual2": _text(y[1]),
            "trim_id": trim, "total_trims": ways, "exp_pos1": expected[0], "exp_pos2": expected[1],
        })
    return "remap", out


def sample_haplotypes(read: Alignment, seq: str, qual: Sequence[int], variants: Sequence[tuple[int, int, Sequence[tuple[str, str]]]], most: int = 64) -> list[tuple[str, list[int]]]:
    """Distinct haplotypes of several samples: variants are (start, stop, alleles of each sample).

    Samples with a missing allele are skipped; inserted bases have quality 30.
    If none can be placed the read itself is returned.
    """
    if not variants:
        return [(seq, list(qual))]
    seen: dict[tuple[str, ...], None] = {}
    for s in range(len(variants[0][2])):
        for h in (0, 1):
            key = tuple(v[2][s][h] for v in variants)
            if not any("." in a for a in key):
                seen.setdefault(key)
    out = []
    for key in list(seen)[:most]:
        edits = [Edit(v[0], v[1], a, a, v[1] - v[0]) for v, a in zip(variants, key, strict=True)]
        spans = spans_on_read(read, edits)
        if spans is None:
            continue
        bases, scores, at = [], [], 0
        for (a, b), allele in zip(spans, key, strict=True):
            bases += [seq[at:a], allele]
            scores += [*qual[at:a], *qual[a : min(b, a + len(allele))], *[DEFAULT_QUALITY] * (len(allele) - (b - a))]
            at = b
        out.append(("".join(bases) + seq[at:], scores + list(qual[at:])))
    return out or [(seq, list(qual))]


def _text(scores: Sequence[int]) -> str:
    return "".join(chr(q + 33) for q in scores)


def _scores(text: str) -> list[int]:
    return [ord(c) - 33 for c in text]


COPIES = "qname string, chrom string, outcome string, name string, seq1 string, qual1 string, seq2 string, qual2 string, reverse1 boolean, reverse2 boolean, trim_id int, total_trims int, exp_pos1 long, exp_pos2 long, overlap_mask byte"


def _overlapping_pairs(alignments: DataFrame, variants: DataFrame, edit: Column, snv: Column) -> DataFrame:
    """Pairs with an overlap: qname, chrom, fields of both mates, edits1, edits2 (sorted, distinct) and overlap_mask."""
    # Records are paired before they meet variants: most have no mate on their chromosome and go with one shuffle.
    pairs = mate_pairs(alignments.select("chrom", "qname", "file_order", "flag", "pos0", "cigar", "seq", "qual"))
    v = variants.select(F.col("chrom").alias("__c"), F.col("pos0").alias("__s"), F.col("end").alias("__e"), edit.alias("edit"), snv.alias("snv"))
    mates = []
    for i in (1, 2):
        m = F.col(f"r{i}")
        mates.append(pairs.select("chrom", "qname", F.lit(i).alias("mate"), m["pos0"].alias("start"), (m["pos0"] + C.reference_length(m["cigar"])).alias("stop")))
    hits = interval_join(mates[0].union(mates[1]), v, ("chrom", "start", "stop"), ("__c", "__s", "__e"), READ_BIN)
    edits = hits.groupBy("chrom", "qname").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("mate") == i, F.col("edit")))).alias(f"edits{i}") for i in (1, 2)],
        C.overlap_mask(F.col("snv"), ~F.col("snv")).alias("overlap_mask"),
    )
    cols = [F.col(f"r{i}.{c}").alias(f"{c}{i}") for i in (1, 2) for c in ("pos0", "cigar", "seq", "qual", "flag")]
    return pairs.join(edits, ["chrom", "qname"]).select("qname", "chrom", *cols, "edits1", "edits2", "overlap_mask")


def _rewritten(pairs: DataFrame, rewrite: Callable[[dict], tuple[str, list[dict]]]) -> DataFrame:
    """COPIES of _overlapping_pairs() by a function from a row to its outcome and copies."""
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "byte": pa.int8()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in COPIES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                outcome, copies = rewrite(r)
                base = {"qname": r["qname"], "chrom": r["chrom"], "outcome": outcome, "overlap_mask": r["overlap_mask"]}
                base |= {f"reverse{i}": bool(r[f"flag{i}"] & REVERSE) for i in (1, 2)}
                out += [base | c for c in copies] or [base]
            yield pa.RecordBatch.from_pylist(out, schema)

    return pairs.mapInArrow(run, COPIES)


def make_copies(alignments: DataFrame, variants: DataFrame, gt: str = "GT", indels: bool = False, max_indel: int = 50, tag: str = C.TAG) -> DataFrame:
    """COPIES: for every pair that overlaps a variant, its changed copies, or one row without a name that tells why there are none.

    variants: chrom, pos0, end, ref, alt, alts (array of all ALTs at the place)
    and the genotype column, in allele indices. Copies of reads on the reverse
    strand are still as aligned; the FASTQ sink turns them.
    """
    both = C.alleles(F.col(gt), F.col("ref"), F.col("alts") if "alts" in variants.columns else F.array("alt"))
    v = variants.withColumn("__a", both).where("size(__a) = 2 and not exists(__a, x -> x is null)")
    h1, h2 = F.col("__a")[0], F.col("__a")[1]
    edit = F.struct(F.col("pos0").alias("start"), F.col("end").alias("stop"), h1.alias("hap1"), h2.alias("hap2"), F.length("ref").alias("ref_len"))
    snv = (F.length("ref") == 1) & (F.length(h1) == 1) & (F.length(h2) == 1)

    def rewrite(r: dict) -> tuple[str, list[dict]]:
        m = [Mate(r[f"pos0{i}"], r[f"cigar{i}"], r[f"seq{i}"], _scores(r[f"qual{i}"]), [Edit(**e) for e in r[f"edits{i}"]]) for i in (1, 2)]
        return pair_copies(r["qname"], *m, indels, max_indel, tag=tag)

    return _rewritten(_overlapping_pairs(alignments, v, edit, snv), rewrite)


def make_sample_copies(alignments: DataFrame, variants: DataFrame, samples: Sequence[str], most: int = 64, tag: str = C.TAG) -> DataFrame:
    """COPIES with the distinct haplotypes of several samples, whose genotypes are in GT_<sample>.

    The mates' haplotypes are taken side by side, as many as the mate with fewer has.
    """
    alts = F.col("alts") if "alts" in variants.columns else F.array("alt")
    pair = lambda s: F.coalesce(C.alleles(F.col(f"GT_{s}"), F.col("ref"), alts), F.array(F.lit("."), F.lit(".")))
    edit = F.struct(F.col("pos0").alias("start"), F.col("end").alias("stop"), F.array(*map(pair, samples)).alias("alleles"))
    snv = (F.length("ref") == 1) & (F.length("alt") == 1)

    def rewrite(r: dict) -> tuple[str, list[dict]]:
        sides = []
        for i in (1, 2):
            v = [(e["start"], e["stop"], [tuple(a) for a in e["alleles"]]) for e in r[f"edits{i}"]]
            sides.append(sample_haplotypes(Alignment.of(r[f"pos0{i}"], r[f"cigar{i}"]), r[f"seq{i}"], _scores(r[f"qual{i}"]), v, most))
        many = max(map(len, sides))
        sides = [x * many if not r[f"edits{i}"] else x for i, x in zip((1, 2), sides, strict=True)]
        found = [(x, y) for x, y in zip(*sides, strict=False) if (x[0], y[0]) != (r["seq1"], r["seq2"])]
        out = []
        for nth, (x, y) in enumerate(found, 1):
            name = r["qname"] + tag + "_".join(map(str, (r["pos01"], r["pos02"], nth, len(found))))
            out.append({"name": name, "seq1": x[0], "qual1": _text(x[1]), "seq2": y[0], "qual2": _text(y[1]), "trim_id": 0, "total_trims": 1, "exp_pos1": r["pos01"], "exp_pos2": r["pos02"]})
        return ("remap" if out else "keep"), out

    return _rewritten(_overlapping_pairs(alignments, variants, edit, snv), rewrite)


def copy_stats(copies: DataFrame) -> DataFrame:
    """Pairs by outcome, and copies."""
    named = F.col("name").isNotNull()
    kinds = [F.count_distinct(F.when(F.col("outcome") == o, F.struct("chrom", "qname"))).alias(f"pairs_{o}") for o in ("remap", "keep", "unmappable")]
    return copies.agg(*kinds, F.count_if(named).alias("copies"), F.count_if(named & (F.col("overlap_mask") >= 2)).alias("copies_indel"))

"""Registered queries of the variant-calling operators, each with DuckDB SQL.

The driver's tables hold no reads, so observations, reads, reference bases and region
lines are derived from them by SQL that both engines read alike.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numbers, tokens
from .operators import admission, candidates, depth, encode, pileup, reads, regions, scan, scoring, sweep, vcf
from .plans.calling import read_scored, write_scored
from .sources import bam, bed, fasta, sam
from .store import mounted, shared_path, written

PLOIDY, WINDOW, MIN_AF, RD_FLOOR = 4, 2, 0.1, 10

# ------------------------------------------------------------ derived tables

OBS = """
SELECT chrom, pos, concat(cast(ok AS varchar(20)),'_',cast(ln AS varchar(20)),'_',cast(flag AS varchar(20))) qname,
       flag, mapq, tok AS token, refb, s
FROM (SELECT *, CASE WHEN s=0 AND h<5 THEN alt1
                     WHEN s=1 AND h<4 THEN concat(refb,'+2TG')
                     WHEN s=1 AND h=4 THEN concat(refb,'+12ACGTACGTACGT')
                     WHEN s=2 AND h<4 THEN concat(refb,'-3NNN')
                     WHEN s=3 AND h<3 THEN '*'
                     WHEN s=4 AND h<4 THEN concat(refb,'+25ACGTACGTACGTACGTACGTACGTA')
                     WHEN s=5 AND h<3 THEN alt1 WHEN s=5 AND h<6 THEN alt2
                     WHEN s=6 AND h<2 THEN 'N' ELSE refb END tok
      FROM (SELECT concat('chr', cast(1 + l_suppkey % 2 AS varchar(10))) chrom,
                   cast(l_partkey + 1 AS bigint) pos, l_orderkey ok, l_linenumber ln,
                   cast(l_quantity AS int) mapq,
                   (CASE l_linenumber % 4 WHEN 0 THEN 99 WHEN 1 THEN 147 WHEN 2 THEN 83 ELSE 163 END)
                     + (CASE WHEN l_quantity = 50 THEN 1024 ELSE 0 END)
                     + (CASE WHEN l_discount > 0.095 THEN 256 ELSE 0 END) flag,
                   substr('ACGTACGTACG',  cast(1 + (l_partkey*5) % 4 + (l_partkey % 7) AS int), 1) refb,
                   substr('CGTACGTACGTA', cast(1 + (l_partkey*5) % 4 + (l_partkey % 7) AS int), 1) alt1,
                   substr('GTACGTACGTAC', cast(1 + (l_partkey*5) % 4 + (l_partkey % 7) AS int), 1) alt2,
                   l_orderkey % 10 h, (l_partkey + 1) % 11 s
            FROM lineitem
            WHERE (l_partkey + 1) % 97 >= 3) b) t"""

REFS = """
SELECT chrom, cast(p_partkey + 1 AS bigint) pos, CASE WHEN (p_partkey + 1) % 23 = 0 THEN lower(b) ELSE b END base
FROM (SELECT p_partkey, substr('ACGTACGTACG', cast(1 + (p_partkey*5) % 4 + (p_partkey % 7) AS int), 1) b FROM part) p
CROSS JOIN (VALUES ('chr1'), ('chr2')) AS c(chrom)"""

READS = """
SELECT concat(cast(l_orderkey AS varchar(20)),'_',cast(l_linenumber AS varchar(20))) qname,
       (CASE l_linenumber % 4 WHEN 0 THEN 99 WHEN 1 THEN 147 WHEN 2 THEN 83 ELSE 163 END) + (CASE WHEN l_quantity = 50 THEN 1024 ELSE 0 END) flag,
       concat('chr', cast(1 + l_suppkey % 2 AS varchar(10))) chrom, cast(l_partkey + 1 AS bigint) pos, cast(l_quantity AS int) mapq,
       CASE l_linenumber % 4 WHEN 0 THEN '10M' WHEN 1 THEN '5M2I5M' WHEN 2 THEN '4M3D6M' ELSE '3S5M2N2M1H' END cigar,
       CASE l_linenumber % 4 WHEN 0 THEN 'ACGTACGTAC' WHEN 1 THEN 'ACGTATGCGTAC' WHEN 2 THEN 'ACGTACGTAC' ELSE 'TTTACGTACG' END seq
FROM lineitem"""

# reads are ten bases long but observed at one, so contigs count ten times their bases
CONTIGS = """
SELECT chrom, cast((max(pos) + 20) * 10 AS bigint) length, cast(row_number() OVER (ORDER BY chrom) AS int) ord
FROM (SELECT concat('chr', cast(1 + l_suppkey % 2 AS varchar(10))) chrom, l_partkey + 1 pos FROM lineitem) l GROUP BY chrom"""

#: Contigs of a fifth of that length, so the genome's depth, and not the floor, decides.
DEEP_CONTIGS = CONTIGS.replace("* 10 AS", "* 2 AS")

LINES = """
SELECT cast(o_orderkey AS bigint) line_no,
       CASE WHEN o_orderkey % 50 = 0 THEN '# a remark' WHEN o_orderkey % 50 = 1 THEN 'track name=x' WHEN o_orderkey % 50 = 2 THEN 'browser position' WHEN o_orderkey % 50 = 3 THEN '  '
            ELSE concat('chr', cast(2 - o_orderkey % 3 % 2 AS varchar(10)), chr(9), cast((o_orderkey * 7919) % 400009 AS varchar(20)), chr(9), cast((o_orderkey * 7919) % 400009 + o_custkey % 50 AS varchar(20)), chr(9), 'x') END value
FROM orders"""

_DERIVED = {"obs": OBS, "refs": REFS, "reads": READS, "contigs": CONTIGS, "deep_contigs": DEEP_CONTIGS, "lines": LINES}
_BASE = ("lineitem", "part", "orders")


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, tables = _DERIVED[name], {}
    for t in _BASE:
        if f"FROM {t}" in text:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
            tables[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(text, **tables)


class _Tables:
    """Derived tables of one folder, and what several queries make of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return _derived(self.spark, self.sf_dir, name)

    def usable(self) -> DataFrame:
        return reads.read_filter(self.obs.drop("refb", "s"))

    def depths(self) -> DataFrame:
        return depth.contig_depth(reads.read_filter(self.reads), self.contigs)

    def least(self, ploidy: int = PLOIDY) -> int:
        return max(round(depth.genome_depth_value(self.depths()) / ploidy), RD_FLOOR)

    def swept(self, least: int, reference: DataFrame | None = None, **rules) -> DataFrame:
        """Columns and candidates in one pass over the counted tokens."""
        return sweep.swept(encode.strand_tokens(self.usable()), self.refs if reference is None else reference, least=least, min_af=MIN_AF, **rules)

    def candidates(self, ploidy: int = PLOIDY) -> DataFrame:
        return sweep.sites_of(self.swept(self.least(ploidy)))

    def deep_candidates(self, ploidy: int) -> DataFrame:
        depths = depth.contig_depth(reads.read_filter(self.reads), self.deep_contigs)
        return sweep.sites_of(self.swept(max(round(depth.genome_depth_value(depths) / ploidy), RD_FLOOR)))

    def windows(self) -> DataFrame:
        """Candidates with full windows; the table that was swept is written, as its edges are met again."""
        mean = depth.genome_depth_value(self.depths())
        table = written(self.swept(max(round(mean / PLOIDY), RD_FLOOR), depth=mean, window=WINDOW), "columns")
        return sweep.windows_of(table, WINDOW)

    def tokens(self) -> DataFrame:
        return candidates.with_reference(pileup.token_counts(self.usable()), self.refs)

    def columns(self) -> DataFrame:
        """Every column with its number and 30 features."""
        table = written(self.swept(1, depth=depth.genome_depth_value(self.depths()), every=True), "columns")
        return sweep.featured_columns(sweep.numbered(table))

    def scored(self) -> DataFrame:
        return scoring.binomial_scores(self.candidates(), PLOIDY).withColumn("pred_prob", F.col("pred_prob").cast("float"))


# ------------------------------------------------------------------ oracle SQL

_FILTERED = "SELECT * FROM obs WHERE (flag & 3852) = 0 AND ((flag & 1) = 0 OR (flag & 2) = 2) AND mapq >= 5"
_TOKENS = "SELECT t.*, CASE WHEN base IN ('A','C','G','T') THEN base ELSE '*' END ref FROM (SELECT chrom, pos, upper(token) token, count(*) n FROM f WHERE pos >= 2 GROUP BY 1, 2, 3) t JOIN refs USING (chrom, pos)"
_ALLELES = """SELECT chrom, pos, kind, allele, cast(sum(n) AS int) n FROM (
 SELECT chrom, pos, 'SNP' kind, substr(token,1,1) allele, n FROM tr WHERE token <> '*' AND substr(token,1,1) <> ref
 UNION ALL SELECT chrom, pos, 'INS', split_part(token,'+',2), n FROM tr WHERE contains(token,'+')
 UNION ALL SELECT chrom, pos, 'DEL', split_part(token,'-',2), n FROM tr WHERE contains(token,'-')) GROUP BY 1, 2, 3, 4"""
_TOPS = "SELECT chrom, pos, kind, allele, n FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, kind ORDER BY n DESC, allele) rn FROM alleles) WHERE rn = 1"
_SITES = """SELECT c.*, s.allele snp, coalesce(s.n,0) snp_n, i.allele ins, coalesce(i.n,0) ins_n, d.allele del, coalesce(d.n,0) del_n
FROM (SELECT chrom, pos, ref, cast(sum(n) AS int) rd, cast(coalesce(sum(n) FILTER (token = ref),0) AS int) ref_num FROM tr GROUP BY 1, 2, 3) c
LEFT JOIN tops s ON s.chrom = c.chrom AND s.pos = c.pos AND s.kind = 'SNP'
LEFT JOIN tops i ON i.chrom = c.chrom AND i.pos = c.pos AND i.kind = 'INS'
LEFT JOIN tops d ON d.chrom = c.chrom AND d.pos = c.pos AND d.kind = 'DEL'"""
_DEPTHS = """SELECT c.chrom, c.length, round(sum(span) / c.length, 2) mean FROM (
 SELECT chrom, list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda x: cast(x AS bigint))) span FROM reads
 WHERE (flag & 3852) = 0 AND ((flag & 1) = 0 OR (flag & 2) = 2) AND mapq >= 5) r JOIN contigs c USING (chrom) GROUP BY 1, 2"""
_GENOME = "SELECT cast(round_even(sum(mean * length) / sum(length), 0) AS int) depth FROM depths"


def _cand(ploidy: int) -> str:
    return f"""SELECT chrom, pos, CASE kind WHEN 'DEL' THEN span ELSE ref END ref,
 CASE kind WHEN 'SNP' THEN snp WHEN 'INS' THEN ref || regexp_replace(ins, '^\\d+', '') ELSE ref END alt, kind, rd, ref_num, alt_num
FROM (SELECT *, (SELECT string_agg(CASE WHEN base IN ('A','C','G','T') THEN base ELSE '*' END, '' ORDER BY r.pos) FROM refs r WHERE kind = 'DEL' AND r.chrom = k.chrom AND r.pos BETWEEN k.pos AND k.pos + len) span
 FROM (SELECT *, greatest(snp_n, ins_n, del_n) alt_num,
   CASE WHEN snp_n >= ins_n AND snp_n >= del_n THEN 'SNP' WHEN ins_n >= snp_n AND ins_n >= del_n THEN 'INS' ELSE 'DEL' END kind,
   coalesce(try_cast(regexp_extract(del, '^(\\d+)', 1) AS int), 0) len
  FROM sites WHERE ref <> '*' AND rd >= (SELECT greatest(cast(round_even(depth / {ploidy}, 0) AS int), {RD_FLOOR}) FROM genome)) k
 WHERE alt_num > 0 AND alt_num / rd >= {MIN_AF} AND (kind = 'SNP' OR (kind = 'INS' AND length(regexp_replace(ins, '^\\d+', '')) <= 20) OR (kind = 'DEL' AND len <= 20)))"""


_ST = "SELECT chrom, pos, (flag & 16) >> 4 strand, upper(token) token, count(*) n, sum(mapq) mq FROM f WHERE pos >= 2 GROUP BY 1, 2, 3, 4"
_STOPS = """SELECT chrom, pos, strand, max(allele) FILTER (kind = 'INS') ins, max(n) FILTER (kind = 'INS') ins_n, max(allele) FILTER (kind = 'DEL') del, max(n) FILTER (kind = 'DEL') del_n
FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, strand, kind ORDER BY n DESC, allele) rn FROM (
 SELECT chrom, pos, strand, kind, allele, sum(n) n FROM (
  SELECT chrom, pos, strand, 'INS' kind, split_part(token,'+',2) allele, n FROM st WHERE contains(token,'+')
  UNION ALL SELECT chrom, pos, strand, 'DEL', split_part(token,'-',2), n FROM st WHERE contains(token,'-')) GROUP BY 1, 2, 3, 4, 5)) WHERE rn = 1 GROUP BY 1, 2, 3"""


def _sum(cond: str, value: str) -> str:
    return f"cast(coalesce(sum(CASE WHEN {cond} THEN {value} ELSE 0 END), 0) AS bigint)"


_REAL = "NOT contains(token,'*') AND substr(token,1,1) IN ('A','C','G','T')"
_STRAND_COLUMNS = ", ".join(
    [f"{_sum(f"substr(token,1,1) = '{b}'", 'n')} {b.lower()}" for b in "ACGT"]
    + ["cast(max(coalesce(ins_n,0)) AS bigint) is1", "cast(max(coalesce(del_n,0)) AS bigint) ds1", f"{_sum("token = '*'", 'n')} dr"]
    + [f"{_sum(f"{_REAL} AND substr(token,1,1) = '{b}'", 'mq')} mq_{b.lower()}" for b in "ACGT"]
    + [f"{_sum(f"{_REAL} AND ins IS NOT NULL AND contains(token, '+' || regexp_extract(ins, '^(\\d+)', 1))", 'mq')} mq_ins"]
    + [f"{_sum(f"{_REAL} AND del IS NOT NULL AND contains(token, '-' || regexp_extract(del, '^(\\d+)', 1))", 'mq')} mq_del"]
    + [f"{_sum("contains(token,'*')", 'mq')} mq_star"]
)
_SF = f"SELECT st.chrom, st.pos, st.strand, {_STRAND_COLUMNS} FROM st LEFT JOIN stops USING (chrom, pos, strand) GROUP BY 1, 2, 3"
# written out here, so that a change of the operators' own list shows
_STRAND_NAMES = ("a", "c", "g", "t", "is1", "ds1", "dr", "mq_a", "mq_c", "mq_g", "mq_t", "mq_ins", "mq_del", "mq_star")
_SIDES = ((1, "rev"), (0, "fwd"))
_FEATURE_NAMES = ("depth", "ref_code", *(f"{side}_{x}" for _, side in _SIDES for x in _STRAND_NAMES))
_FLAT = ", ".join(f"cast(sum(CASE WHEN strand = {s} THEN {x} ELSE 0 END) AS bigint) {side}_{x}" for s, side in _SIDES for x in _STRAND_NAMES)
_FEATURES = f"""SELECT c.chrom, c.pos, (SELECT depth FROM genome) depth, cast(CASE base WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS int) ref_code, {', '.join(_FEATURE_NAMES[2:])}
FROM (SELECT chrom, pos, {_FLAT} FROM sf GROUP BY 1, 2) c JOIN refs USING (chrom, pos)"""
_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) ord, count(*) OVER (PARTITION BY chrom) n_cols FROM features"
_REGIONS = """SELECT line_no, split_part(value, chr(9), 1) chrom, cast(split_part(value, chr(9), 2) AS bigint) + 1 start1, cast(split_part(value, chr(9), 3) AS bigint) + 1 end1
FROM lines WHERE NOT regexp_matches(value, '^(track|browser|#)') AND trim(value) <> '' AND cast(split_part(value, chr(9), 3) AS bigint) > cast(split_part(value, chr(9), 2) AS bigint)"""
_MERGED = """SELECT chrom, min(start1) start1, max(end1) end1 FROM (
 SELECT *, sum(CASE WHEN start1 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start1, end1) island FROM (
  SELECT *, max(end1) OVER (PARTITION BY chrom ORDER BY start1, end1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM regions)) GROUP BY chrom, island"""


def _binomial(ploidy: int, error: float = 0.01) -> str:
    qs = [(k / ploidy) * (1 - error) + (1 - k / ploidy) * error for k in range(ploidy + 1)]
    logs = ", ".join(f"alt_num * ln({q!r}) + (rd - alt_num) * ln({1 - q!r})" for q in qs)
    return f"""SELECT * EXCLUDE (l, p), list_max(p) pred_prob, cast(list_position(p, list_max(p)) - 1 AS int) pred_label FROM (
 SELECT *, list_transform(l, lambda x: exp(x - list_max(l)) / list_sum(list_transform(l, lambda y: exp(y - list_max(l))))) p FROM (SELECT *, [{logs}] l FROM cand))"""


_FIELDS = """SELECT *, cast(qual AS int) - CASE WHEN cast(qual AS int) > qual THEN 1 ELSE 0 END gq, greatest(rd, 1) dp, ref_num || ',' || alt_num ad, cast(printf('%.4f', alt_num / greatest(rd, 1)) AS double) af,
 CASE pred_label WHEN 0 THEN '.' ELSE alt END shown_alt, CASE pred_label WHEN 0 THEN 'RefCall' ELSE 'PASS' END "filter",
 array_to_string(list_concat(list_transform(range(4 - pred_label), lambda x: '0'), list_transform(range(pred_label), lambda x: '1')), '/') gt
 FROM (SELECT *, round_even(-10.0 * log10(1.0 - least(greatest(cast(cast(pred_prob AS float) AS double), 1e-8), 1 - pow(2.0, -24))) * 100, 0) / 100 qual FROM scored)"""
_LINES = """SELECT chrom, pos, concat_ws(chr(9), chrom, cast(pos AS varchar), '.', ref, shown_alt,
 regexp_replace(regexp_replace(printf('%.2f', qual), '0+$', ''), '\\.$', '.0'), "filter", '.', 'GT:GQ:DP:AD:AF',
 concat_ws(':', gt, cast(gq AS varchar), cast(dp AS varchar), ad, regexp_replace(regexp_replace(printf('%.4f', af), '0+$', ''), '\\.$', '.0'))) line FROM fields"""

_CTES = {
    "obs": OBS, "refs": REFS, "reads": READS, "contigs": CONTIGS, "lines": LINES, "f": _FILTERED, "tr": _TOKENS, "alleles": _ALLELES, "tops": _TOPS, "sites": _SITES, "depths": _DEPTHS, "genome": _GENOME,
    "cand": _cand(PLOIDY), "st": _ST, "stops": _STOPS, "sf": _SF, "features": _FEATURES, "numbered": _NUMBERED, "regions": _REGIONS, "merged": _MERGED, "scored": _binomial(PLOIDY), "fields": _FIELDS, "vlines": _LINES,
}
_NEEDS = {
    "f": "obs", "tr": "f refs", "alleles": "tr", "tops": "alleles", "sites": "tr tops", "depths": "reads contigs", "genome": "depths", "cand": "sites refs genome", "st": "f", "stops": "st", "sf": "st stops",
    "features": "sf refs genome", "numbered": "features", "regions": "lines", "merged": "regions", "scored": "cand", "fields": "scored", "vlines": "fields",
}


def _sql(needs: str, select: str, **own: str) -> str:
    """The statement, after the tables that it and they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, "").split():
            add(x)
        if name not in order:
            order.append(name)

    for x in needs.split():
        add(x)
    ctes = _CTES | own
    return "WITH " + ",\n".join(f"{x} AS ({ctes[x]})" for x in order) + f"\n{select}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def put(f: Callable[[_Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(_Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# ----------------------------------------------------------------- the queries


@_query("read_filter", _sql("f", "SELECT chrom, pos, qname, flag, mapq, token FROM f"))
def _read_filter(t: _Tables) -> DataFrame:
    return t.usable()


@_query("read_rename_strand", _sql("f", "SELECT qname || '_' || flag qname, chrom, pos, cast((flag & 16) >> 4 AS int) strand FROM f"))
def _read_rename(t: _Tables) -> DataFrame:
    return reads.rename_reads(t.usable()).select("qname", "chrom", "pos", "strand")


@_query("read_admission", None)
def _admission(t: _Tables) -> DataFrame:
    """Reads that a cap of a dozen admits; whether one is hangs on those before it, which SQL doesn't express (tests hold it against the rule read by read)."""
    return admission.admitted(t.reads, 12).select("qname", "flag", "chrom", "pos")


@_query("contig_depth", _sql("depths", "SELECT * FROM depths"))
def _contig_depth(t: _Tables) -> DataFrame:
    return t.depths()


@_query("genome_depth", _sql("genome", "SELECT * FROM genome"))
def _genome_depth(t: _Tables) -> DataFrame:
    return depth.genome_depth(t.depths())


@_query("min_depth_threshold", _sql("tr genome", f"SELECT chrom, pos, cast(sum(n) AS int) rd FROM tr GROUP BY 1, 2 HAVING sum(n) >= (SELECT greatest(cast(round_even(depth / {PLOIDY}, 0) AS int), {RD_FLOOR}) FROM genome)"))
def _min_depth(t: _Tables) -> DataFrame:
    least = depth.genome_depth(t.depths()).select(numbers.min_depth(F.col("depth"), PLOIDY, RD_FLOOR).alias("least"))
    return pileup.pileup_columns(t.usable(), t.refs).join(F.broadcast(least), F.col("rd") >= F.col("least")).select("chrom", "pos", "rd")


@_query("pileup_columns", _sql("f refs", "SELECT c.chrom, c.pos, base AS ref, rd FROM (SELECT chrom, pos, cast(count(*) AS int) rd FROM f WHERE pos >= 2 GROUP BY 1, 2) c JOIN refs USING (chrom, pos)"))
def _pileup(t: _Tables) -> DataFrame:
    return pileup.pileup_columns(t.usable(), t.refs)


@_query("pileup_observations", _sql("reads", """SELECT chrom, pos + off AS pos, qname, flag, mapq, token FROM (
 SELECT *, unnest(CASE cigar WHEN '10M' THEN range(10) WHEN '5M2I5M' THEN range(10) WHEN '4M3D6M' THEN range(13) ELSE range(9) END) off,
  unnest(CASE cigar WHEN '10M' THEN list_transform(range(10), lambda i: substr(seq, i + 1, 1))
   WHEN '5M2I5M' THEN list_transform(range(10), lambda i: CASE WHEN i < 4 THEN substr(seq, i + 1, 1) WHEN i = 4 THEN substr(seq, 5, 1) || '+2' || substr(seq, 6, 2) ELSE substr(seq, i + 3, 1) END)
   WHEN '4M3D6M' THEN list_transform(range(13), lambda i: CASE WHEN i < 3 THEN substr(seq, i + 1, 1) WHEN i = 3 THEN substr(seq, 4, 1) || '-3NNN' WHEN i < 7 THEN '*' ELSE substr(seq, i - 2, 1) END)
   ELSE list_transform(range(9), lambda i: CASE WHEN i < 5 THEN substr(seq, i + 4, 1) WHEN i < 7 THEN CASE WHEN flag & 16 = 0 THEN '>' ELSE '<' END ELSE substr(seq, i + 2, 1) END) END) token FROM reads)"""))
def _observations(t: _Tables) -> DataFrame:
    return pileup.observations(t.reads)


@_query("softmask_reference", _sql("refs", "SELECT chrom, pos, base, CASE WHEN base IN ('A','C','G','T') THEN base ELSE '*' END masked, cast(CASE base WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS int) code FROM refs"))
def _softmask(t: _Tables) -> DataFrame:
    masked = tokens.soft_masked(F.col("base"))
    return t.refs.select("chrom", "pos", "base", masked.alias("masked"), tokens.base_code(masked).alias("code"))


def _top(kind: str) -> Callable[[_Tables], DataFrame]:
    k = kind.lower()
    return lambda t: candidates.top_alleles(candidates.allele_counts(t.tokens()).where(F.col("kind") == kind)).select("chrom", "pos", F.col(k).alias("allele"), F.col(f"{k}_n").alias("n"))


for _name, _kind in (("top_snp_allele", "SNP"), ("top_insertion_allele", "INS"), ("top_deletion_allele", "DEL")):
    _query(_name, _sql("tops", f"SELECT chrom, pos, allele, n FROM tops WHERE kind = '{_kind}'"))(_top(_kind))


@_query("ref_allele_count", _sql("sites", "SELECT chrom, pos, ref, ref_num FROM sites"))
def _ref_count(t: _Tables) -> DataFrame:
    return candidates.site_table(t.usable(), t.refs).select("chrom", "pos", "ref", "ref_num")


@_query("variant_kind", _sql("sites", "SELECT chrom, pos, greatest(snp_n, ins_n, del_n) alt_num, CASE WHEN snp_n >= ins_n AND snp_n >= del_n THEN 'SNP' WHEN ins_n >= snp_n AND ins_n >= del_n THEN 'INS' ELSE 'DEL' END kind FROM sites"))
def _kind_query(t: _Tables) -> DataFrame:
    return candidates.site_table(t.usable(), t.refs).select("chrom", "pos", F.greatest("snp_n", "ins_n", "del_n").alias("alt_num"), candidates.chosen_kind(F.col("snp_n"), F.col("ins_n"), F.col("del_n")).alias("kind"))


@_query("candidate_sites", _sql("cand", "SELECT * FROM cand"))
def _candidates(t: _Tables) -> DataFrame:
    return t.candidates()


@_query("candidate_sites_hexaploid", _sql("cand", "SELECT * FROM cand", cand=_cand(6), contigs=DEEP_CONTIGS))
def _hexaploid(t: _Tables) -> DataFrame:
    return t.deep_candidates(6)


@_query("candidate_sites_by_depth", _sql("cand", "SELECT * FROM cand", contigs=DEEP_CONTIGS))
def _by_depth(t: _Tables) -> DataFrame:
    return t.deep_candidates(PLOIDY)


@_query("candidate_sites_in_blocks", _sql("cand", "SELECT * FROM cand"))
def _in_blocks(t: _Tables) -> DataFrame:
    """The reference as blocks of 50 bases in place of a row a base."""
    line = F.floor(F.col("pos") / 50)
    blocks = t.refs.groupBy("chrom", line.alias("line")).agg(F.min("pos").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("seq"))
    return sweep.sites_of(t.swept(t.least(), blocks.select("chrom", "start", "seq")))


@_query("deletion_ref_span", _sql("tops refs", "SELECT t.chrom, t.pos, string_agg(CASE WHEN base IN ('A','C','G','T') THEN base ELSE '*' END, '' ORDER BY r.pos) span FROM tops t JOIN refs r ON r.chrom = t.chrom AND r.pos BETWEEN t.pos AND t.pos + cast(regexp_extract(t.allele, '^(\\d+)', 1) AS int) WHERE kind = 'DEL' GROUP BY 1, 2"))
def _deletion_span(t: _Tables) -> DataFrame:
    tops = candidates.top_alleles(candidates.allele_counts(t.tokens())).where("del is not null")
    return candidates.deletion_spans(tops.select("chrom", "pos", tokens.indel_length(F.col("del")).alias("n")), t.refs)


@_query("bed_parse_filter", _sql("regions", "SELECT * FROM regions"))
def _bed(t: _Tables) -> DataFrame:
    return regions.parse_bed(t.lines)


@_query("bed_chrom_order", _sql("lines", "SELECT chrom, cast(row_number() OVER (ORDER BY first) AS int) ord FROM (SELECT split_part(value, chr(9), 1) chrom, min(line_no) first FROM lines WHERE NOT regexp_matches(value, '^(track|browser|#)') AND trim(value) <> '' GROUP BY 1)"))
def _bed_order(t: _Tables) -> DataFrame:
    return regions.bed_contigs(t.lines)


@_query("interval_merge", _sql("merged", "SELECT * FROM merged"))
def _merge(t: _Tables) -> DataFrame:
    return regions.merge_intervals(regions.parse_bed(t.lines))


@_query("region_semi_join", _sql("cand regions", "SELECT * FROM cand c WHERE EXISTS (SELECT 1 FROM regions r WHERE r.chrom = c.chrom AND c.pos >= r.start1 AND c.pos < r.end1)"))
def _semi(t: _Tables) -> DataFrame:
    return sweep.sites_of(t.swept(t.least(), regions=regions.parse_bed(t.lines)))


@_query("invalid_contigs", _sql("contigs", "SELECT chrom FROM (SELECT DISTINCT 'chr' || (o_custkey % 5) chrom FROM orders) EXCEPT SELECT chrom FROM contigs"))
def _invalid(t: _Tables) -> DataFrame:
    asked = t.spark.read.parquet(f"{t.sf_dir}/orders.parquet").select(F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")).alias("chrom"))
    return regions.invalid_contigs(asked, t.contigs)


def _strand_query(name: str, columns: tuple[str, ...]) -> None:
    chosen = ", ".join(columns)
    _query(name, _sql("sf", f"SELECT chrom, pos, cast(strand AS int) strand, {chosen} FROM sf"))(lambda t: encode.strand_features(t.usable()).select("chrom", "pos", "strand", *columns))


_strand_query("strand_base_counts", _STRAND_NAMES[:4])
_strand_query("strand_indel_stats", _STRAND_NAMES[4:7])
_strand_query("strand_mapq_sums", _STRAND_NAMES[7:])


@_query("column_features_30", _sql("features", "SELECT * FROM features"))
def _features(t: _Tables) -> DataFrame:
    table = t.swept(1, depth=depth.genome_depth_value(t.depths()), every=True)
    return sweep.featured_columns(table).select("chrom", "pos", *encode.FEATURES)


@_query("column_ordinals", _sql("numbered", "SELECT chrom, pos, ord, n_cols FROM numbered"))
def _ordinals(t: _Tables) -> DataFrame:
    table = written(t.swept(1, every=True, featured=False), "columns")
    return sweep.numbered(table).select("chrom", "pos", F.col("ord").cast("bigint").alias("ord"), "n_cols")


@_query("full_window_sites", _sql("numbered", f"SELECT chrom, pos FROM numbered WHERE ord >= {WINDOW} + 2 AND ord <= n_cols - {WINDOW}"))
def _full(t: _Tables) -> DataFrame:
    return encode.full_windows(t.columns(), WINDOW).select("chrom", "pos")


@_query("window_rows_frame", _sql("features", f"SELECT chrom, pos, cast(sum(rev_a + fwd_a) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN {WINDOW} PRECEDING AND {WINDOW} FOLLOWING) AS bigint) around FROM features"))
def _frame(t: _Tables) -> DataFrame:
    return sweep.framed(t.columns(), WINDOW, "around", F.sum(F.col("rev_a") + F.col("fwd_a"))).select("chrom", "pos", "around")


_S1, _S2 = " + ".join(_FEATURE_NAMES), " + ".join(f"{i} * {x}" for i, x in enumerate(_FEATURE_NAMES, 1))
_TENSOR = _sql("numbered cand", f"""SELECT c.chrom, c.pos, cast(count(*) * 30 AS int) size, cast(sum((m.ord - n.ord + {WINDOW}) * 30 * ({_S1.replace('depth', 'm.depth')}) + ({_S2.replace('depth', 'm.depth')})) AS double) checksum
FROM cand c JOIN (SELECT chrom, pos, ord, n_cols FROM numbered) n ON n.chrom = c.chrom AND n.pos = c.pos JOIN numbered m ON m.chrom = n.chrom AND m.ord BETWEEN n.ord - {WINDOW} AND n.ord + {WINDOW}
WHERE n.ord >= {WINDOW} + 2 AND n.ord <= n.n_cols - {WINDOW} GROUP BY 1, 2""")


def _tensor(ordinal_join: bool) -> Callable[[_Tables], DataFrame]:
    def run(t: _Tables) -> DataFrame:
        x = encode.window_tensors(t.columns(), t.candidates().select("chrom", "pos"), WINDOW, True) if ordinal_join else t.windows()
        weighted = F.aggregate(F.transform("x", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v)
        return x.select("chrom", "pos", F.size("x").alias("size"), weighted.alias("checksum"))

    return run


_query("window_tensor", _TENSOR)(_tensor(False))
_query("window_tensor_ordinal_join", _TENSOR)(_tensor(True))


@_query("chunk_assignment", _sql("contigs f", "SELECT f.chrom, f.pos, cast(floor((f.pos - 1) / greatest(length // 16, 1)) AS bigint) chunk FROM (SELECT DISTINCT chrom, pos FROM f) f JOIN contigs USING (chrom)"))
def _chunks(t: _Tables) -> DataFrame:
    size = F.greatest(F.floor(F.col("length") / 16), F.lit(1))
    return t.usable().select("chrom", "pos").distinct().join(t.contigs, "chrom").select("chrom", "pos", F.floor((F.col("pos") - 1) / size).alias("chunk"))


_STANDARD = " + ".join(f"({x} - {i}) / {i + 1}.0" for i, x in enumerate(_FEATURE_NAMES))


@_query("standardize_features", _sql("features", f"SELECT chrom, pos, round({_STANDARD}, 6) total FROM features"))
def _standard(t: _Tables) -> DataFrame:
    n = len(encode.FEATURES)
    x = scoring.standardized(encode.feature_array(), [float(i) for i in range(n)], [i + 1.0 for i in range(n)])
    return _features(t).select("chrom", "pos", F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@_query("dosage_binomial_scores", _sql("scored", "SELECT chrom, pos, round(pred_prob, 6) pred_prob, pred_label FROM scored"))
def _dosage(t: _Tables) -> DataFrame:
    return scoring.binomial_scores(t.candidates(), PLOIDY).select("chrom", "pos", F.round("pred_prob", 6).alias("pred_prob"), "pred_label")


#: Of the linear predictor: entry e of class k weighs ((e * 7 + k * 13) % 11 - 5) / 1024 of what is left of the standardized entry, whose mean is e % 3 and std 4.
_CLASSES = PLOIDY + 1
_ENTRIES = (2 * WINDOW + 1) * 30
_Z = ", ".join(f"sum((e - mod(i, 3)) / 4.0 * (mod(i * 7 + {k * 13}, 11) - 5) / 1024.0) z{k}" for k in range(_CLASSES))
_LINEAR = f"""SELECT chrom, pos, ref, alt, kind, rd, ref_num, alt_num, round(list_max(p), 3) pred_prob, cast(list_position(p, list_max(p)) - 1 AS int) pred_label FROM (
 SELECT *, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z))))) p FROM (
  SELECT chrom, pos, ref, alt, kind, rd, ref_num, alt_num, [{', '.join(f'z{k}' for k in range(_CLASSES))}] z FROM (
   SELECT c.chrom, c.pos, c.ref, c.alt, c.kind, c.rd, c.ref_num, c.alt_num, {_Z} FROM cand c JOIN numbered n ON n.chrom = c.chrom AND n.pos = c.pos
   JOIN (SELECT chrom, ord, unnest([{', '.join(_FEATURE_NAMES)}]) e, unnest(range(30)) f FROM numbered) m ON m.chrom = n.chrom AND m.ord BETWEEN n.ord - {WINDOW} AND n.ord + {WINDOW}
   CROSS JOIN LATERAL (SELECT (m.ord - n.ord + {WINDOW}) * 30 + m.f i) WHERE n.ord >= {WINDOW} + 2 AND n.ord <= n.n_cols - {WINDOW} GROUP BY ALL)))"""


@_query("batch_inference", _sql("numbered cand", _LINEAR))
def _inference(t: _Tables) -> DataFrame:
    """Standardized by a statistics file, reshaped and scored by a linear predictor in batches."""
    entry, label = np.arange(_ENTRIES)[:, None], np.arange(_CLASSES)[None, :]
    path = os.path.join(_scratch(t.spark), "statistics.npz")
    np.savez(path, mean=np.arange(_ENTRIES) % 3, std=np.full(_ENTRIES, 4.0))
    scored = scoring.batch_scores(t.windows(), scoring.linear(((entry * 7 + label * 13) % 11 - 5) / 1024), WINDOW, *scoring.read_statistics(path))
    return scored.withColumn("pred_prob", F.round(F.col("pred_prob").cast("double"), 3))


@_query("scored_parquet", _sql("scored", "SELECT chrom, pos, round(pred_prob, 6) pred_prob, pred_label FROM scored"))
def _scored_parquet(t: _Tables) -> DataFrame:
    """Scored sites written by contig as zstd Parquet, and read back."""
    path = shared_path(t.spark, "scored")
    write_scored(scoring.binomial_scores(t.candidates(), PLOIDY), path)
    return read_scored(t.spark, path).select("chrom", "pos", F.round("pred_prob", 6).alias("pred_prob"), "pred_label")


@_query("genotype_string", _sql("fields", "SELECT chrom, pos, pred_label, gt FROM fields"))
def _genotype(t: _Tables) -> DataFrame:
    return vcf.record_fields(t.scored(), PLOIDY).select("chrom", "pos", "pred_label", "gt")


@_query("qual_gq", _sql("fields", "SELECT chrom, pos, round(qual, 1) qual, gq FROM fields"))
def _qual(t: _Tables) -> DataFrame:
    return vcf.record_fields(t.scored(), PLOIDY).select("chrom", "pos", F.round("qual", 1).alias("qual"), "gq")


@_query("af_ad_dp", _sql("fields", "SELECT chrom, pos, af, ad, dp FROM fields"))
def _af(t: _Tables) -> DataFrame:
    return vcf.record_fields(t.scored(), PLOIDY).select("chrom", "pos", "af", "ad", "dp")


@_query("vcf_filter_alt", _sql("fields", 'SELECT chrom, pos, shown_alt, "filter" FROM fields'))
def _filter_alt(t: _Tables) -> DataFrame:
    return vcf.record_fields(t.scored(), PLOIDY).select("chrom", "pos", "shown_alt", "filter")


@_query("vcf_records", _sql("vlines", "SELECT * FROM vlines"))
def _records(t: _Tables) -> DataFrame:
    return vcf.record_lines(t.scored(), PLOIDY)


# Fixed values of the file's header, written out here so that a change of the operators' own shows.
_HEADER = (
    "##fileformat=VCFv4.2",
    '##FILTER=<ID=PASS,Description="All filters passed">',
    '##FILTER=<ID=RefCall,Description="Genotyping model thinks this site is reference.">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype Quality">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read depth">',
    '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Allelic depths for the ref and alt alleles in the order listed">',
    '##FORMAT=<ID=AF,Number=A,Type=Float,Description="Allele Frequency, for each ALT allele, in the same order as listed">',
)
_HEAD = " UNION ALL ".join(f"SELECT 0 section, {k} chrom_ord, '{x}' line" for k, x in enumerate(_HEADER))
_HEAD += " UNION ALL SELECT 1, ord, '##contig=<ID=' || chrom || ',length=' || length || '>' FROM contigs UNION ALL SELECT 2, 0, '#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE'"
_ORDERED = _sql("contigs vlines", f"SELECT row_number() OVER (ORDER BY section, chrom_ord, pos) AS number, line FROM (SELECT *, 0 pos FROM ({_HEAD}) UNION ALL SELECT 3, ord, line, pos FROM vlines JOIN contigs USING (chrom))")


@_query("vcf_header", _sql("contigs", _HEAD))
def _header(t: _Tables) -> DataFrame:
    return vcf.header_lines(t.contigs)


@_query("vcf_ordered_output", _ORDERED)
def _ordered(t: _Tables) -> DataFrame:
    """File order as a number; counted part by part, as each is range-partitioned and sorted. The sorted lines are written once."""
    own = vcf.vcf_lines(t.scored(), t.contigs, PLOIDY).orderBy("section", "chrom_ord", "pos").withColumn("id", F.monotonically_increasing_id())
    own = written(own.select("id", F.shiftright("id", 33).alias("part"), "line"), "ordered")
    totals = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = totals.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a part
    return own.join(before, "part").select((F.col("id") - F.col("first") + 1 + F.col("before")).alias("number"), "line")


@_query("chunk_union", _sql("cand", "SELECT * FROM cand"))
def _union(t: _Tables) -> DataFrame:
    """Candidates of each chunk of positions by itself, put together: each sees its own positions, and bases as far as a deletion reaches."""
    obs, refs, least = t.usable(), t.refs, t.least()
    size = (refs.agg(F.max("pos")).first()[0] or 0) // 5 + 1
    parts = []
    for k in range(6):
        inside = F.col("pos").between(k * size, (k + 1) * size - 1)
        seen = F.col("pos").between(k * size, (k + 1) * size + 20)
        parts.append(candidates.candidate_sites(obs.where(inside), refs.where(seen), least, MIN_AF))
    return functools.reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------ sources and sinks


def _scratch(spark: SparkSession) -> str:
    """A new folder for one-file sinks in the shared folder, which has to be mounted for them."""
    root = shared_path(spark, "files")
    path = mounted(root)
    if path is None:
        raise ValueError("one-file sinks need a shared folder that is mounted; elsewhere write parts")
    os.makedirs(path, exist_ok=True)
    return path


def _fasta(t: _Tables) -> str:
    """The reference as a FASTA file of 50 bases a line, written by Spark's text writer."""
    own = t.refs.withColumn("i", F.row_number().over(Window.partitionBy("chrom").orderBy("pos")) - 1)  # a test's table
    lines = own.groupBy("chrom", F.floor(F.col("i") / 50).alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "base"))), lambda x: x["base"]), "").alias("value"))
    heads = own.select("chrom").distinct().select("chrom", F.lit(-1).cast("bigint").alias("line"), F.concat(F.lit(">"), "chrom", F.lit(" made")).alias("value"))
    path = shared_path(t.spark, "fasta")
    lines.unionByName(heads).coalesce(1).sortWithinPartitions("chrom", "line").select("value").write.text(path)
    return path


_BASES = "SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY pos) pos, base FROM refs"


@_query("fasta_bases", _sql("refs", _BASES))
def _fasta_bases(t: _Tables) -> DataFrame:
    return fasta.fasta_bases(t.spark, _fasta(t))


@_query("fasta_contigs", _sql("refs", "SELECT chrom, count(*) length, cast(row_number() OVER (ORDER BY chrom) AS int) ord FROM refs GROUP BY 1"))
def _fasta_contigs(t: _Tables) -> DataFrame:
    return fasta.fasta_contigs(t.spark, _fasta(t))


@_query("fasta_index", _sql("refs", """SELECT chrom, length, cast(sum(size) OVER (ORDER BY chrom) - size + length(chrom) + 7 AS bigint) "offset", 50 line_bases, 51 line_width
FROM (SELECT chrom, count(*) length, length(chrom) + 7 + count(*) + cast(ceil(count(*) / 50) AS bigint) size FROM refs GROUP BY 1)"""))
def _fasta_index(t: _Tables) -> DataFrame:
    return fasta.fai_lines(t.spark, _fasta(t))


_ALIGNED = "SELECT qname, flag, chrom, pos, mapq, cigar, seq FROM reads"


@_query("sam_scan", _sql("reads", _ALIGNED))
def _sam_scan(t: _Tables) -> DataFrame:
    path = shared_path(t.spark, "sam")
    line = F.concat_ws("\t", "qname", F.col("flag").cast("string"), "chrom", F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*"))
    t.reads.select(line.alias("value")).unionAll(t.spark.createDataFrame([("@HD\tVN:1.6\tSO:unsorted",)], "value string")).write.text(path)
    return sam.read_sam(t.spark, path)


def _written_bam(t: _Tables) -> str:
    path = os.path.join(_scratch(t.spark), "reads.bam")
    bam.write_bam(t.reads, [(r.chrom, r.length) for r in t.contigs.orderBy("ord").collect()], path)
    bam.register(t.spark)
    return path


def _bam(t: _Tables, **options: str) -> DataFrame:
    return t.spark.read.format("bam").options(range_bytes=100_000, **options).load(_written_bam(t))


@_query("bam_header", _sql("contigs", "SELECT chrom, length, ord FROM contigs"))
def _bam_header(t: _Tables) -> DataFrame:
    found = bam.read_header(_written_bam(t))[1]  # a row a contig
    return t.spark.createDataFrame([(n, size, k) for k, (n, size) in enumerate(found, 1)], "chrom string, length bigint, ord int")


_SPAN = "greatest(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda x: cast(x AS bigint))), 1)"
_LEVELS = " ".join(f"WHEN (a >> {14 + 3 * k}) = ((z - 1) >> {14 + 3 * k}) THEN {((1 << 3 * (5 - k)) - 1) // 7} + (a >> {14 + 3 * k})" for k in range(5))


@_query("bam_index_bins", _sql("reads", f"SELECT DISTINCT chrom, cast(CASE {_LEVELS} ELSE 0 END AS bigint) bin FROM (SELECT chrom, pos - 1 a, cast(pos - 1 + {_SPAN} AS bigint) z FROM reads)"))
def _bam_bins(t: _Tables) -> DataFrame:
    """Bins of the index that the sink leaves."""
    path = _written_bam(t)
    index = bam.read_bam_index(path, [n for n, _ in bam.read_header(path)[1]])
    return t.spark.createDataFrame([(n, b) for n in index.names for b in index.bins[n]], "chrom string, bin bigint")


#: 1-based, half open; two of them overlap.
_ASKED = (("chr1", 30, 31), ("chr1", 101, 140), ("chr1", 120, 150), ("chr2", 5, 12))


@_query("bam_overlap_scan", _sql("reads", f"{_ALIGNED} WHERE " + " OR ".join(f"(chrom = '{c}' AND pos < {z} AND pos + {_SPAN} > {a})" for c, a, z in _ASKED)))
def _bam_overlap(t: _Tables) -> DataFrame:
    """Reads that overlap a region, read through the index."""
    return _bam(t, regions=json.dumps(_ASKED))


@_query("bam_scan", _sql("reads", _ALIGNED))
def _bam_scan(t: _Tables) -> DataFrame:
    """Written as one file and read in parts that begin wherever their bytes do."""
    return _bam(t)


@_query("bam_region_scan", _sql("reads", f"{_ALIGNED} WHERE chrom = 'chr2' AND pos >= 20 AND pos < 120"))
def _bam_region(t: _Tables) -> DataFrame:
    return _bam(t).where("chrom in ('chr2') and pos >= 20 and pos < 120")


@_query("bed_file", _sql("regions", "SELECT chrom, start1, end1 FROM regions"))
def _bed_file(t: _Tables) -> DataFrame:
    path = shared_path(t.spark, "bed")
    t.lines.select("value").write.option("compression", "gzip").text(path)
    return bed.read_bed(t.spark, path)


@_query("vcf_file", _ORDERED)
def _vcf_written(t: _Tables) -> DataFrame:
    """Block-compressed parts in a folder, and their lines in order: numbered in each part by their place in it."""
    folder = os.path.join(_scratch(t.spark), "calls")
    vcf.write_vcf_parts(vcf.vcf_lines(t.scored(), t.contigs, PLOIDY), folder)
    lines = t.spark.read.format("bgzf").option("range_bytes", 4000).load(folder).withColumn("all", F.lit(0))
    before = scan.before_in_parts(lines.groupBy("all", "file").agg(F.count(F.lit(1)).alias("n")), "all", "file", "n")  # a row a part
    own = F.row_number().over(Window.partitionBy("file").orderBy("offset"))
    return lines.withColumn("own", own).join(before, ["all", "file"]).select((F.col("before") + F.col("own")).alias("number"), "line")


@_query("tabix_region", _sql("vlines", "SELECT line FROM vlines WHERE chrom = 'chr2' AND pos BETWEEN 50 AND 150"))
def _tabix(t: _Tables) -> DataFrame:
    """One file of joined parts, read by its index."""
    path = os.path.join(_scratch(t.spark), "calls.vcf.gz")
    vcf.write_vcf(vcf.vcf_lines(t.scored(), t.contigs, PLOIDY), path)
    return vcf.region_lines(t.spark, path, "chr2", 50, 150)

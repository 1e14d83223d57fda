"""Readers and writers of tab-separated and bioinformatic formats."""

from .formats import bed2tsv, fasta2tsv, fastq2tsv, gtf2tsv, sam2tsv, tsv2bed, tsv2fasta, tsv2fastq, tsv2gtf, tsv2sam, tsv2vcf, vcf2tsv
from .matrix import mm2tsv, tsv2mm
from .tsv import read_csv, read_tsv, write_csv, write_tsv

__all__ = [
    "bed2tsv", "fasta2tsv", "fastq2tsv", "gtf2tsv", "mm2tsv", "read_csv", "read_tsv", "sam2tsv", "tsv2bed", "tsv2fasta", "tsv2fastq", "tsv2gtf", "tsv2mm", "tsv2sam", "tsv2vcf", "vcf2tsv", "write_csv", "write_tsv"
]

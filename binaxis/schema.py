"""Schemas of all tables, and fixed values."""

from __future__ import annotations

CONTACTS = "chrom string, resolution int, bin_i bigint, bin_j bigint, count double"
DOMAINS = "algorithm string, chrom string, resolution int, start bigint, end bigint"
CALLED = "chrom string, resolution int, start bigint, end bigint"
CONSENSUS = "chrom string, resolution int, position bigint, support int, color string"
PEAKS = "chrom string, start bigint, end bigint"
HIERARCHY = "start_bin int, end_bin int, depth int, score1 double, score2 double"
BED6 = "chrom string, start bigint, end bigint, name string, score int, strand string"

# Colours of consensus boundaries by support, and hg19 chromosome sizes in bp.
CONSENSUS_COLORS = {2: "#FFD700", 3: "#FF8C00", 4: "#00C800"}
HG19 = {
    "chr1": 249250621, "chr2": 243199373, "chr3": 198022430, "chr4": 191154276, "chr5": 180915260, "chr6": 171115067,
    "chr7": 159138663, "chr8": 146364022, "chr9": 141213431, "chr10": 135534747, "chr11": 135006516, "chr12": 133851895,
    "chr13": 115169878, "chr14": 107349540, "chr15": 102531392, "chr16": 90354753, "chr17": 81195210, "chr18": 78077248,
    "chr19": 59128983, "chr20": 63025520, "chr21": 48129895, "chr22": 51304566, "chrX": 155270560,
}

KEY = ["chrom", "resolution"]

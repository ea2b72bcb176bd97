"""Fixed tables of the JPEG and H.264 standards, and the small dimension DataFrames made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Quantisation tables K.1 and K.2 of ITU-T T.81, row by row.
LUMA_STEPS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA_STEPS = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)

# Huffman tables K.3 to K.6 of ITU-T T.81, as counts of codes by length and symbols in order.
HUFFMAN = {
    "dc_luma": ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), bytes(range(12))),
    "dc_chroma": ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), bytes(range(12))),
    "ac_luma": (
        (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
        bytes.fromhex(
            "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
            "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
            "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
        ),
    ),
    "ac_chroma": (
        (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
        bytes.fromhex(
            "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
            "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
            "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
        ),
    ),
}

# Chroma quantisation parameter for luma parameters from 30 to 51.
CHROMA_QP = (29, 30, 31, 32, 32, 33, 34, 34, 35, 35, 36, 36, 37, 37, 37, 38, 38, 38, 39, 39, 39, 39)
# Scaling of H.264 levels, and forward multipliers, by parameter modulo 6 and class of position.
LEVEL_SCALE = ((10, 16, 13), (11, 18, 14), (13, 20, 16), (14, 23, 18), (16, 25, 20), (18, 29, 23))
FORWARD = ((13107, 5243, 8066), (11916, 4660, 7490), (10082, 4194, 6554), (9362, 3647, 5825), (8192, 3355, 5243), (7282, 2893, 4559))
# Coded block patterns of intra macroblocks in the order of their code numbers, and of inter macroblocks.
CBP_INTRA = (47, 31, 15, 0, 23, 27, 29, 30, 7, 11, 13, 14, 39, 43, 45, 46, 16, 3, 5, 10, 12, 19, 21, 26, 28, 35, 37, 42, 44, 1, 2, 4, 8, 17, 18, 20, 24, 6, 9, 22, 25, 32, 33, 34, 36, 40, 38, 41)
CBP_INTER = (0, 16, 1, 2, 4, 8, 32, 3, 5, 10, 12, 15, 47, 7, 11, 13, 14, 6, 9, 31, 35, 37, 42, 44, 33, 34, 36, 40, 39, 43, 45, 46, 17, 18, 20, 24, 19, 21, 26, 28, 23, 27, 29, 30, 22, 25, 38, 41)
# Deblocking thresholds by index.
ALPHA = (0,) * 16 + (4, 4, 5, 6, 7, 8, 9, 10, 12, 13, 15, 17, 20, 22, 25, 28, 32, 36, 40, 45, 50, 56, 63, 71, 80, 90, 101, 113, 127, 144, 162, 182, 203, 226, 255, 255)
BETA = (0,) * 16 + (2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 14, 14, 15, 15, 16, 16, 17, 17, 18, 18)
# Macroblocks of a frame and macroblocks a second that each H.264 level admits.
LEVELS = (("1", 99, 1485), ("1.1", 396, 3000), ("1.2", 396, 6000), ("1.3", 396, 11880), ("2", 396, 11880), ("2.1", 792, 19800), ("2.2", 1620, 20250), ("3", 1620, 40500), ("3.1", 3600, 108000), ("3.2", 5120, 216000), ("4", 8192, 245760), ("4.1", 8192, 245760), ("4.2", 8704, 522240), ("5", 22080, 589824), ("5.1", 36864, 983040), ("5.2", 36864, 2073600))
# Names by code.
MARKERS = {0xD8: "SOI", 0xD9: "EOI", 0xC0: "SOF0", 0xC1: "SOF1", 0xC2: "SOF2", 0xC4: "DHT", 0xDB: "DQT", 0xDD: "DRI", 0xDA: "SOS", 0xE0: "APP0", 0xE1: "APP1", 0xFE: "COM"}
NAL_TYPES = {1: "SLICE", 2: "DPA", 3: "DPB", 4: "DPC", 5: "IDR", 6: "SEI", 7: "SPS", 8: "PPS", 9: "AUD", 10: "END_SEQ", 11: "END_STREAM", 12: "FILLER"}
PROFILES = {66: "Baseline", 77: "Main", 88: "Extended", 100: "High"}
INTRA4_MODES = ("Vertical", "Horizontal", "DC", "DiagonalDownLeft", "DiagonalDownRight", "VerticalRight", "HorizontalDown", "VerticalLeft", "HorizontalUp")


def zigzag(size: int = 8) -> list[int]:
    """Row-major places in the order of the zigzag scan: along the diagonals, by turns up and down."""
    return [y * size + x for y, x in sorted(((y, x) for y in range(size) for x in range(size)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))]


def huffman_codes(name: str) -> list[tuple[int, int, int]]:
    """(symbol, length, code): canonical codes; those of a length follow those of the length before, doubled."""
    counts, symbols = HUFFMAN[name]
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out.append((s, length, code))
            code += 1
        at, code = at + n, code * 2
    return out


def steps(spark: SparkSession) -> DataFrame:
    """(table, u, v, step): u counts rows."""
    return spark.createDataFrame([(t, i // 8, i % 8, s) for t, values in (("luma", LUMA_STEPS), ("chroma", CHROMA_STEPS)) for i, s in enumerate(values)], "table string, u int, v int, step int")


def huffman(spark: SparkSession) -> DataFrame:
    """(table, symbol, len, code) of all standard tables."""
    return spark.createDataFrame([(t, *row) for t in HUFFMAN for row in huffman_codes(t)], "table string, symbol int, len int, code int")


def names(spark: SparkSession, of: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(sorted(of.items()), "code int, name string")

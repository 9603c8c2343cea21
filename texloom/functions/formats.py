"""Dimension tables: surface formats, DXGI codes, FourCC codes and mask patterns, as small literal DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from texloom.functions.local import local_table

# The codes of the public DXGI_FORMAT enumeration.
DXGI_TEXT = """
0 UNKNOWN
1 R32G32B32A32_TYPELESS
2 R32G32B32A32_FLOAT
3 R32G32B32A32_UINT
4 R32G32B32A32_SINT
5 R32G32B32_TYPELESS
6 R32G32B32_FLOAT
7 R32G32B32_UINT
8 R32G32B32_SINT
9 R16G16B16A16_TYPELESS
10 R16G16B16A16_FLOAT
11 R16G16B16A16_UNORM
12 R16G16B16A16_UINT
13 R16G16B16A16_SNORM
14 R16G16B16A16_SINT
15 R32G32_TYPELESS
16 R32G32_FLOAT
17 R32G32_UINT
18 R32G32_SINT
19 R32G8X24_TYPELESS
20 D32_FLOAT_S8X24_UINT
21 R32_FLOAT_X8X24_TYPELESS
22 X32_TYPELESS_G8X24_UINT
23 R10G10B10A2_TYPELESS
24 R10G10B10A2_UNORM
25 R10G10B10A2_UINT
26 R11G11B10_FLOAT
27 R8G8B8A8_TYPELESS
28 R8G8B8A8_UNORM
29 R8G8B8A8_UNORM_SRGB
30 R8G8B8A8_UINT
31 R8G8B8A8_SNORM
32 R8G8B8A8_SINT
33 R16G16_TYPELESS
34 R16G16_FLOAT
35 R16G16_UNORM
36 R16G16_UINT
37 R16G16_SNORM
38 R16G16_SINT
39 R32_TYPELESS
40 D32_FLOAT
41 R32_FLOAT
42 R32_UINT
43 R32_SINT
44 R24G8_TYPELESS
45 D24_UNORM_S8_UINT
46 R24_UNORM_X8_TYPELESS
47 X24_TYPELESS_G8_UINT
48 R8G8_TYPELESS
49 R8G8_UNORM
50 R8G8_UINT
51 R8G8_SNORM
52 R8G8_SINT
53 R16_TYPELESS
54 R16_FLOAT
55 D16_UNORM
56 R16_UNORM
57 R16_UINT
58 R16_SNORM
59 R16_SINT
60 R8_TYPELESS
61 R8_UNORM
62 R8_UINT
63 R8_SNORM
64 R8_SINT
65 A8_UNORM
66 R1_UNORM
67 R9G9B9E5_SHAREDEXP
68 R8G8_B8G8_UNORM
69 G8R8_G8B8_UNORM
70 BC1_TYPELESS
71 BC1_UNORM
72 BC1_UNORM_SRGB
73 BC2_TYPELESS
74 BC2_UNORM
75 BC2_UNORM_SRGB
76 BC3_TYPELESS
77 BC3_UNORM
78 BC3_UNORM_SRGB
79 BC4_TYPELESS
80 BC4_UNORM
81 BC4_SNORM
82 BC5_TYPELESS
83 BC5_UNORM
84 BC5_SNORM
85 B5G6R5_UNORM
86 B5G5R5A1_UNORM
87 B8G8R8A8_UNORM
88 B8G8R8X8_UNORM
89 R10G10B10_XR_BIAS_A2_UNORM
90 B8G8R8A8_TYPELESS
91 B8G8R8A8_UNORM_SRGB
92 B8G8R8X8_TYPELESS
93 B8G8R8X8_UNORM_SRGB
94 BC6H_TYPELESS
95 BC6H_UF16
96 BC6H_SF16
97 BC7_TYPELESS
98 BC7_UNORM
99 BC7_UNORM_SRGB
100 AYUV
101 Y410
102 Y416
103 NV12
104 P010
105 P016
106 OPAQUE_420
107 YUY2
108 Y210
109 Y216
110 NV11
111 AI44
112 IA44
113 P8
114 A8P8
115 B4G4R4A4_UNORM
130 P208
131 V208
132 V408
133 ASTC_4X4_TYPELESS
134 ASTC_4X4_UNORM
135 ASTC_4X4_UNORM_SRGB
137 ASTC_5X4_TYPELESS
138 ASTC_5X4_UNORM
139 ASTC_5X4_UNORM_SRGB
141 ASTC_5X5_TYPELESS
142 ASTC_5X5_UNORM
143 ASTC_5X5_UNORM_SRGB
145 ASTC_6X5_TYPELESS
146 ASTC_6X5_UNORM
147 ASTC_6X5_UNORM_SRGB
149 ASTC_6X6_TYPELESS
150 ASTC_6X6_UNORM
151 ASTC_6X6_UNORM_SRGB
153 ASTC_8X5_TYPELESS
154 ASTC_8X5_UNORM
155 ASTC_8X5_UNORM_SRGB
157 ASTC_8X6_TYPELESS
158 ASTC_8X6_UNORM
159 ASTC_8X6_UNORM_SRGB
161 ASTC_8X8_TYPELESS
162 ASTC_8X8_UNORM
163 ASTC_8X8_UNORM_SRGB
165 ASTC_10X5_TYPELESS
166 ASTC_10X5_UNORM
167 ASTC_10X5_UNORM_SRGB
169 ASTC_10X6_TYPELESS
170 ASTC_10X6_UNORM
171 ASTC_10X6_UNORM_SRGB
173 ASTC_10X8_TYPELESS
174 ASTC_10X8_UNORM
175 ASTC_10X8_UNORM_SRGB
177 ASTC_10X10_TYPELESS
178 ASTC_10X10_UNORM
179 ASTC_10X10_UNORM_SRGB
181 ASTC_12X10_TYPELESS
182 ASTC_12X10_UNORM
183 ASTC_12X10_UNORM_SRGB
185 ASTC_12X12_TYPELESS
186 ASTC_12X12_UNORM
187 ASTC_12X12_UNORM_SRGB
191 A4B4G4R4_UNORM
"""
DXGI: dict[int, str] = {int(code): name for code, name in (line.split() for line in DXGI_TEXT.split("\n") if line)}
DXGI_CODE: dict[str, int] = {name: code for code, name in DXGI.items()}

# Name, channels, precision, header versions, FourCC, DXGI code, encodable, split rows, dithering, local dithering, size multiple.
FORMAT_TEXT = """
R8G8B8_UNORM                   Rgb        U8   9     -     -    yes  1  C    -      -
B8G8R8_UNORM                   Rgb        U8   9     -     -    yes  1  C    -      -
R8G8B8A8_UNORM                 Rgba       U8   9+10  -     28   yes  1  C+A  -      -
R8G8B8A8_SNORM                 Rgba       U8   9+10  -     31   yes  1  C+A  -      -
B8G8R8A8_UNORM                 Rgba       U8   9+10  -     87   yes  1  C+A  -      -
B8G8R8X8_UNORM                 Rgb        U8   9+10  -     88   yes  1  C    -      -
B5G6R5_UNORM                   Rgb        U8   9+10  -     85   yes  1  C    -      -
B5G5R5A1_UNORM                 Rgba       U8   9+10  -     86   yes  1  C+A  -      -
B4G4R4A4_UNORM                 Rgba       U8   9+10  -     115  yes  1  C+A  -      -
A4B4G4R4_UNORM                 Rgba       U8   10    -     191  yes  1  C+A  -      -
R8_SNORM                       Grayscale  U8   10    -     63   yes  1  C    -      -
R8_UNORM                       Grayscale  U8   9+10  -     61   yes  1  C    -      -
R8G8_UNORM                     Rgb        U8   9+10  -     49   yes  1  C    -      -
R8G8_SNORM                     Rgb        U8   9+10  -     51   yes  1  C    -      -
A8_UNORM                       Alpha      U8   9+10  -     65   yes  1  A    -      -
R16_UNORM                      Grayscale  U16  9+10  -     56   yes  1  C    -      -
R16_SNORM                      Grayscale  U16  10    -     58   yes  1  C    -      -
R16G16_UNORM                   Rgb        U16  9+10  -     35   yes  1  C    -      -
R16G16_SNORM                   Rgb        U16  9+10  -     37   yes  1  C    -      -
R16G16B16A16_UNORM             Rgba       U16  9+10  -     11   yes  1  C+A  -      -
R16G16B16A16_SNORM             Rgba       U16  9+10  -     13   yes  1  C+A  -      -
R10G10B10A2_UNORM              Rgba       U16  9+10  -     24   yes  1  C+A  -      -
R11G11B10_FLOAT                Rgb        F32  10    -     26   yes  1  C    -      -
R9G9B9E5_SHAREDEXP             Rgb        F32  10    -     67   yes  1  C    -      -
R16_FLOAT                      Grayscale  F32  9+10  -     54   yes  1  C    -      -
R16G16_FLOAT                   Rgb        F32  9+10  -     34   yes  1  C    -      -
R16G16B16A16_FLOAT             Rgba       F32  9+10  -     10   yes  1  C+A  -      -
R32_FLOAT                      Grayscale  F32  9+10  -     41   yes  1  -    -      -
R32G32_FLOAT                   Rgb        F32  9+10  -     16   yes  1  -    -      -
R32G32B32_FLOAT                Rgb        F32  10    -     6    yes  1  -    -      -
R32G32B32A32_FLOAT             Rgba       F32  9+10  -     2    yes  1  -    -      -
R10G10B10_XR_BIAS_A2_UNORM     Rgba       F32  10    -     89   yes  1  C+A  -      -
AYUV                           Rgba       U8   10    -     100  yes  1  C+A  -      -
Y410                           Rgba       U16  10    -     101  yes  1  C+A  -      -
Y416                           Rgba       U16  10    -     102  yes  1  C+A  -      -
R1_UNORM                       Grayscale  U8   10    -     66   yes  1  C    -      -
R8G8_B8G8_UNORM                Rgb        U8   9+10  RGBG  68   yes  1  -    -      -
G8R8_G8B8_UNORM                Rgb        U8   9+10  GRGB  69   yes  1  -    -      -
UYVY                           Rgb        U8   9     UYVY  -    yes  1  -    -      -
YUY2                           Rgb        U8   9+10  YUY2  107  yes  1  -    -      -
Y210                           Rgb        U16  10    -     108  yes  1  -    -      -
Y216                           Rgb        U16  10    -     109  yes  1  -    -      -
NV12                           Rgb        U8   10    -     103  yes  -  -    -      2x2
P010                           Rgb        U16  10    -     104  yes  -  -    -      2x2
P016                           Rgb        U16  10    -     105  yes  -  -    -      2x2
BC1_UNORM                      Rgba       U8   9+10  DXT1  71   yes  4  C+A  local  -
BC2_UNORM                      Rgba       U8   9+10  DXT3  74   yes  4  C+A  local  -
BC2_UNORM_PREMULTIPLIED_ALPHA  Rgba       U8   9+10  DXT2  -    yes  4  C+A  local  -
BC3_UNORM                      Rgba       U8   9+10  DXT5  77   yes  4  C+A  local  -
BC3_UNORM_PREMULTIPLIED_ALPHA  Rgba       U8   9+10  DXT4  -    yes  4  C+A  local  -
BC4_UNORM                      Grayscale  U8   9+10  BC4U  80   yes  4  C    local  -
BC4_SNORM                      Grayscale  U8   9+10  BC4S  81   yes  4  C    local  -
BC5_UNORM                      Rgb        U8   9+10  BC5U  83   yes  4  C    local  -
BC5_SNORM                      Rgb        U8   9+10  BC5S  84   yes  4  C    local  -
BC6H_UF16                      Rgb        F32  10    -     95   no   -  -    -      -
BC6H_SF16                      Rgb        F32  10    -     96   no   -  -    -      -
BC7_UNORM                      Rgba       U8   10    -     98   yes  4  C+A  local  -
ASTC_4X4_UNORM                 Rgba       U8   10    -     134  no   -  -    -      -
ASTC_5X4_UNORM                 Rgba       U8   10    -     138  no   -  -    -      -
ASTC_5X5_UNORM                 Rgba       U8   10    -     142  no   -  -    -      -
ASTC_6X5_UNORM                 Rgba       U8   10    -     146  no   -  -    -      -
ASTC_6X6_UNORM                 Rgba       U8   10    -     150  no   -  -    -      -
ASTC_8X5_UNORM                 Rgba       U8   10    -     154  no   -  -    -      -
ASTC_8X6_UNORM                 Rgba       U8   10    -     158  no   -  -    -      -
ASTC_8X8_UNORM                 Rgba       U8   10    -     162  no   -  -    -      -
ASTC_10X5_UNORM                Rgba       U8   10    -     166  no   -  -    -      -
ASTC_10X6_UNORM                Rgba       U8   10    -     170  no   -  -    -      -
ASTC_10X8_UNORM                Rgba       U8   10    -     174  no   -  -    -      -
ASTC_10X10_UNORM               Rgba       U8   10    -     178  no   -  -    -      -
ASTC_12X10_UNORM               Rgba       U8   10    -     182  no   -  -    -      -
ASTC_12X12_UNORM               Rgba       U8   10    -     186  no   -  -    -      -
BC3_UNORM_RXGB                 Rgb        U8   9     RXGB  -    yes  4  C    local  -
BC3_UNORM_NORMAL               Rgb        U8   9+10  -     77   yes  4  C    local  -
"""
FORMATS: list[list[str | None]] = [[None if x == "-" else x for x in line.split()] for line in FORMAT_TEXT.split("\n") if line]

# FourCC codes (text or number) and the DXGI format they stand for.
FOURCC_DXGI: list[tuple[str | int, str]] = [
    ("DXT1", "BC1_UNORM"), ("DXT3", "BC2_UNORM"), ("DXT5", "BC3_UNORM"), ("ATI1", "BC4_UNORM"), ("BC4U", "BC4_UNORM"),
    ("BC4S", "BC4_SNORM"), ("ATI2", "BC5_UNORM"), ("BC5U", "BC5_UNORM"), ("BC5S", "BC5_SNORM"), ("RGBG", "R8G8_B8G8_UNORM"),
    ("GRGB", "G8R8_G8B8_UNORM"), ("YUY2", "YUY2"), (36, "R16G16B16A16_UNORM"), (110, "R16G16B16A16_SNORM"), (111, "R16_FLOAT"),
    (112, "R16G16_FLOAT"), (113, "R16G16B16A16_FLOAT"), (114, "R32_FLOAT"), (115, "R32G32_FLOAT"), (116, "R32G32B32A32_FLOAT"),
]
# FourCC codes without a DXGI format.
FOURCC_ONLY = [("DXT2", "BC2_UNORM_PREMULTIPLIED_ALPHA"), ("DXT4", "BC3_UNORM_PREMULTIPLIED_ALPHA"), ("RXGB", "BC3_UNORM_RXGB"), ("UYVY", "UYVY")]

# Flags, bit count and masks of red, green, blue and alpha in legacy headers, in order of precedence, and the format.
ALPHA, LUMINANCE, RGB, RGBA, LUMINANCE_ALPHA, BUMP_DUDV = 0x2, 0x20000, 0x40, 0x41, 0x20001, 0x80000
MASKS: list[tuple[int, int, int, int, int, int, str]] = [
    (ALPHA, 8, 0, 0, 0, 0xFF, "A8_UNORM"),
    (LUMINANCE, 8, 0xFF, 0, 0, 0, "R8_UNORM"),
    (RGB | LUMINANCE, 8, 0xFF, 0, 0, 0, "R8_UNORM"),
    (LUMINANCE, 16, 0xFFFF, 0, 0, 0, "R16_UNORM"),
    (RGB, 16, 0xF800, 0x7E0, 0x1F, 0, "B5G6R5_UNORM"),
    (RGB, 32, 0xFF0000, 0xFF00, 0xFF, 0, "B8G8R8X8_UNORM"),
    (RGB, 32, 0xFFFF, 0xFFFF0000, 0, 0, "R16G16_UNORM"),
    (RGB, 16, 0xFF, 0xFF00, 0, 0, "R8G8_UNORM"),
    (RGB, 24, 0xFF0000, 0xFF00, 0xFF, 0, "B8G8R8_UNORM"),
    (RGB, 24, 0xFF, 0xFF00, 0xFF0000, 0, "R8G8B8_UNORM"),
    (RGBA, 16, 0xF00, 0xF0, 0xF, 0xF000, "B4G4R4A4_UNORM"),
    (RGBA, 16, 0x7C00, 0x3E0, 0x1F, 0x8000, "B5G5R5A1_UNORM"),
    (RGBA, 32, 0xFF0000, 0xFF00, 0xFF, 0xFF000000, "B8G8R8A8_UNORM"),
    (RGBA, 32, 0xFF, 0xFF00, 0xFF0000, 0xFF000000, "R8G8B8A8_UNORM"),
    (RGBA, 32, 0x3FF00000, 0xFFC00, 0x3FF, 0xC0000000, "R10G10B10A2_UNORM"),
    (BUMP_DUDV, 32, 0xFF, 0xFF00, 0xFF0000, 0xFF000000, "R8G8B8A8_SNORM"),
    (BUMP_DUDV, 16, 0xFF, 0xFF00, 0, 0, "R8G8_SNORM"),
    (BUMP_DUDV, 32, 0xFFFF, 0xFFFF0000, 0, 0, "R16G16_SNORM"),
    (LUMINANCE_ALPHA, 16, 0xFF, 0, 0, 0xFF00, "R8G8_UNORM"),
]

# Formats whose layout the names' channel widths do not tell: (bytes, block width, block height).
_BLOCKS = {
    "R1_UNORM": (1, 8, 1), "R8G8_B8G8_UNORM": (4, 2, 1), "G8R8_G8B8_UNORM": (4, 2, 1), "YUY2": (4, 2, 1), "UYVY": (4, 2, 1), "Y210": (8, 2, 1), "Y216": (8, 2, 1),
    "BC1": (8, 4, 4), "BC2": (16, 4, 4), "BC3": (16, 4, 4), "BC4": (8, 4, 4), "BC5": (16, 4, 4), "BC6H": (16, 4, 4), "BC7": (16, 4, 4),
}
# Bytes a pixel.
_FIXED = {"AYUV": 4, "Y410": 4, "Y416": 8, "V408": 4, "AI44": 1, "IA44": 1, "P8": 1, "A8P8": 2}
# Bytes a pixel of the first plane, bytes a sample of the second, its sub-sampling.
_PLANES = {"NV12": (1, 2, 2, 2), "OPAQUE_420": (1, 2, 2, 2), "P010": (2, 4, 2, 2), "P016": (2, 4, 2, 2), "NV11": (1, 2, 4, 1), "P208": (1, 2, 2, 1)}

#: kind, bytes (a pixel or block), block width and height, plane bytes, sub-sampling
PixelInfo = tuple[str, int, int, int, int, int, int, int]


def pixel_info(name: str) -> PixelInfo | None:
    """Size arithmetic of a format or DXGI name; None where it is not known."""
    if name in _PLANES:
        p1, p2, sx, sy = _PLANES[name]
        return "biplanar", 0, 1, 1, p1, p2, sx, sy
    if m := re.match(r"ASTC_(\d+)X(\d+)_", name):
        return "block", 16, int(m[1]), int(m[2]), 0, 0, 1, 1
    if block := _BLOCKS.get(name) or _BLOCKS.get(name.split("_")[0]):
        return "block", *block, 0, 0, 1, 1
    if size := _FIXED.get(name):
        return "fixed", size, 1, 1, 0, 0, 1, 1
    bits = sum(int(n) for n in re.findall(r"[RGBADXSE](\d+)", re.sub(r"_(TYPELESS|UNORM|SNORM|UINT|SINT|FLOAT|SRGB|SHAREDEXP|XR_BIAS)", "_", name)))
    if name == "R9G9B9E5_SHAREDEXP":
        bits = 32
    return ("fixed", bits // 8, 1, 1, 0, 0, 1, 1) if bits else None


def supported(name: str) -> str | None:
    """The surface format of a DXGI name: typeless and sRGB variants are the linear one."""
    known = {f[0] for f in FORMATS if f[5]}
    plain = name.removesuffix("_SRGB")
    if plain in known:
        return plain
    if name.endswith("_TYPELESS"):
        for end in ("_UNORM", "_FLOAT", "_UF16"):
            if (one := name.removesuffix("_TYPELESS") + end) in known:
                return one if name not in ("R8G8_TYPELESS", "R11G11B10_TYPELESS") else None
    return None


def linear(name: str) -> str:
    return name.removesuffix("_SRGB")


def srgb(name: str) -> str:
    return name + "_SRGB" if name + "_SRGB" in DXGI_CODE else name


def fourcc_number(code: str | int) -> int:
    return code if isinstance(code, int) else int.from_bytes(code.encode(), "little")


FORMAT_SCHEMA = "format string, channels string, precision string, dx9 boolean, dx10 boolean, four_cc string, dxgi int, encodable boolean, split_rows int, dithering string, local_dithering boolean, size_multiple int, kind string, bytes int, block_w int, block_h int, plane1 int, plane2 int, sub_x int, sub_y int"


def format_rows() -> list[tuple]:
    out = []
    for name, channels, precision, headers, four_cc, dxgi, encodable, split, dithering, local, multiple in FORMATS:
        out.append((name, channels.lower(), precision.lower(), "9" in headers, "10" in headers, four_cc, int(dxgi) if dxgi else None, encodable == "yes", int(split) if split else None, dithering, local == "local", 2 if multiple else 1, *pixel_info(name)))
    return out


def formats(spark: SparkSession) -> DataFrame:
    return local_table(spark, format_rows(), FORMAT_SCHEMA)


def dxgi_rows() -> list[tuple]:
    out = []
    for code, name in DXGI.items():
        info = pixel_info(name) if code else None
        out.append((code, name, supported(name), name.endswith("_SRGB"), DXGI_CODE[linear(name)], DXGI_CODE[srgb(name)], *(info or (None,) * 8)))
    return out


def dxgi(spark: SparkSession) -> DataFrame:
    return local_table(spark, dxgi_rows(), "dxgi int, name string, format string, is_srgb boolean, linear int, srgb int, kind string, bytes int, block_w int, block_h int, plane1 int, plane2 int, sub_x int, sub_y int")


def fourcc_rows() -> list[tuple]:
    return [(fourcc_number(c), DXGI_CODE[d], supported(d)) for c, d in FOURCC_DXGI] + [(fourcc_number(c), None, f) for c, f in FOURCC_ONLY]


def fourccs(spark: SparkSession) -> DataFrame:
    return local_table(spark, fourcc_rows(), "four_cc long, dxgi int, format string")


def mask_rows() -> list[tuple]:
    return [(i, *row[:6], DXGI_CODE.get(row[6]), row[6]) for i, row in enumerate(MASKS)]


def masks(spark: SparkSession) -> DataFrame:
    return local_table(spark, mask_rows(), "pattern_no int, pf_flags long, bits long, r_mask long, g_mask long, b_mask long, a_mask long, dxgi int, format string")

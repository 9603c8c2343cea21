"""Fixed tables of the public BC6H/BC7 block formats."""

# Subset of each pixel, row by row, for the 64 partitions into two subsets.
TWO = """
0011001100110011 0001000100010001 0111011101110111 0001001100110111
0000000100010011 0011011101111111 0001001101111111 0000000100110111
0000000000010011 0011011111111111 0000000101111111 0000000000010111
0001011111111111 0000000011111111 0000111111111111 0000000000001111
0000100011101111 0111000100000000 0000000010001110 0111001100010000
0011000100000000 0000100011001110 0000000010001100 0111001100110001
0011000100010000 0000100010001100 0110011001100110 0011011001101100
0001011111101000 0000111111110000 0111000110001110 0011100110011100
0101010101010101 0000111100001111 0101101001011010 0011001111001100
0011110000111100 0101010110101010 0110100101101001 0101101010100101
0111001111001110 0001001111001000 0011001001001100 0011101111011100
0110100110010110 0011110011000011 0110011010011001 0000011001100000
0100111001000000 0010011100100000 0000001001110010 0000010011100100
0110110010010011 0011011011001001 0110001110011100 0011100111000110
0110110011001001 0110001100111001 0111111010000001 0001100011100111
0000111100110011 0011001111110000 0010001011101110 0100010001110111
""".split()

# The same for the 64 partitions into three subsets.
THREE = """
0011001102212222 0001001122112221 0000200122112211 0222002200110111
0000000011221122 0011001100220022 0022002211111111 0011001122112211
0000000011112222 0000111111112222 0000111122222222 0012001200120012
0112011201120112 0122012201220122 0011011211221222 0011200122002220
0001001101121122 0111001120012200 0000112211221122 0022002200221111
0111011102220222 0001000122212221 0000001101220122 0000110022102210
0122012200110000 0012001211222222 0110122112210110 0000011012211221
0022110211020022 0110011020022222 0011012201220011 0000200022112221
0000000211221222 0222002200120011 0011001200220222 0120012001200120
0000111122220000 0120120120120120 0120201212010120 0011220011220011
0011112222000011 0101010122222222 0000000021212121 0022112200221122
0022001100220011 0220122102201221 0101222222220101 0000212121212121
0101010101012222 0222011102220111 0002111200021112 0000211221122112
0222011101110222 0002111211120002 0110011001102222 0000000021122112
0110011022222222 0022001100110022 0022112211220022 0000000000002112
0002000100020001 0222122202221222 0101222222222222 0111201122012220
""".split()

# The pixel of the second subset whose index has an implicit high bit, by partition into two.
FIX_TWO = [15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 2, 8, 2, 2, 8, 8, 15, 2, 8, 2, 2, 8, 8, 2, 2, 15, 15, 6, 8, 2, 8, 15, 15, 2, 8, 2, 2, 2, 15, 15, 6, 6, 2, 6, 8, 15, 15, 2, 2, 15, 15, 15, 15, 15, 2, 2, 15]

# The pixels of the second and third subset whose index has an implicit high bit, by partition into three.
FIX_THREE = [(3, 15), (3, 8), (15, 8), (15, 3), (8, 15), (3, 15), (15, 3), (15, 8), (8, 15), (8, 15), (6, 15), (6, 15), (6, 15), (5, 15), (3, 15), (3, 8), (3, 15), (3, 8), (8, 15), (15, 3), (3, 15), (3, 8), (6, 15), (10, 8), (5, 3), (8, 15), (8, 6), (6, 10), (8, 15), (5, 15), (15, 10), (15, 8), (8, 15), (15, 3), (3, 15), (5, 10), (6, 10), (10, 8), (8, 9), (15, 10), (15, 6), (3, 15), (15, 8), (5, 15), (15, 3), (15, 6), (15, 6), (15, 8), (3, 15), (15, 3), (5, 15), (5, 15), (5, 15), (8, 15), (5, 15), (10, 15), (5, 15), (10, 15), (8, 15), (13, 15), (15, 3), (12, 15), (3, 15), (3, 8)]

# Interpolation weights of 2-, 3- and 4-bit indices, in 64ths.
WEIGHTS = {2: [0, 21, 43, 64], 3: [0, 9, 18, 27, 37, 46, 55, 64], 4: [0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64]}

# By mode of BC7: subsets, partition bits, rotation bits, index-mode bits, colour bits, alpha bits, p-bits (0 none, 1 each end point, 2 shared), index bits, second index bits.
BC7_MODES = [
    (3, 4, 0, 0, 4, 0, 1, 3, 0),
    (2, 6, 0, 0, 6, 0, 2, 3, 0),
    (3, 6, 0, 0, 5, 0, 0, 2, 0),
    (2, 6, 0, 0, 7, 0, 1, 2, 0),
    (1, 0, 2, 1, 5, 6, 0, 2, 3),
    (1, 0, 2, 0, 7, 8, 0, 2, 2),
    (1, 0, 0, 0, 7, 7, 1, 4, 0),
    (2, 6, 0, 0, 5, 5, 1, 2, 0),
]

# The BC6H modes as the public Khronos data format specification lists them. Each line has the mode bits, the
# bits of the first end point, of the deltas of red, green and blue, whether end points are deltas, and then the fields from
# the lowest bit up: channel, end point (w, x, y, z), and bits low..high or one bit; high..low is stored the other way round.
BC6_MODES = """
0 10 5 5 5 1 gy4 by4 bz4 rw0..9 gw0..9 bw0..9 rx0..4 gz4 gy0..3 gx0..4 bz0 gz0..3 bx0..4 bz1 by0..3 ry0..4 bz2 rz0..4 bz3
1 7 6 6 6 1 gy5 gz4 gz5 rw0..6 bz0 bz1 by4 gw0..6 by5 bz2 gy4 bw0..6 bz3 bz5 bz4 rx0..5 gy0..3 gx0..5 gz0..3 bx0..5 by0..3 ry0..5 rz0..5
2 11 5 4 4 1 rw0..9 gw0..9 bw0..9 rx0..4 rw10 gy0..3 gx0..3 gw10 bz0 gz0..3 bx0..3 bw10 bz1 by0..3 ry0..4 bz2 rz0..4 bz3
6 11 4 5 4 1 rw0..9 gw0..9 bw0..9 rx0..3 rw10 gz4 gy0..3 gx0..4 gw10 gz0..3 bx0..3 bw10 bz1 by0..3 ry0..3 bz0 bz2 rz0..3 gy4 bz3
10 11 4 4 5 1 rw0..9 gw0..9 bw0..9 rx0..3 rw10 by4 gy0..3 gx0..3 gw10 bz0 gz0..3 bx0..4 bw10 by0..3 ry0..3 bz1 bz2 rz0..3 bz4 bz3
14 9 5 5 5 1 rw0..8 by4 gw0..8 gy4 bw0..8 bz4 rx0..4 gz4 gy0..3 gx0..4 bz0 gz0..3 bx0..4 bz1 by0..3 ry0..4 bz2 rz0..4 bz3
18 8 6 5 5 1 rw0..7 gz4 by4 gw0..7 bz2 gy4 bw0..7 bz3 bz4 rx0..5 gy0..3 gx0..4 bz0 gz0..3 bx0..4 bz1 by0..3 ry0..5 rz0..5
22 8 5 6 5 1 rw0..7 bz0 by4 gw0..7 gy5 gy4 bw0..7 gz5 bz4 rx0..4 gz4 gy0..3 gx0..5 gz0..3 bx0..4 bz1 by0..3 ry0..4 bz2 rz0..4 bz3
26 8 5 5 6 1 rw0..7 bz1 by4 gw0..7 by5 gy4 bw0..7 bz5 bz4 rx0..4 gz4 gy0..3 gx0..4 bz0 gz0..3 bx0..5 by0..3 ry0..4 bz2 rz0..4 bz3
30 6 6 6 6 0 rw0..5 gz4 bz0 bz1 by4 gw0..5 gy5 by5 bz2 gy4 bw0..5 gz5 bz3 bz5 bz4 rx0..5 gy0..3 gx0..5 gz0..3 bx0..5 by0..3 ry0..5 rz0..5
3 10 10 10 10 0 rw0..9 gw0..9 bw0..9 rx0..9 gx0..9 bx0..9
7 11 9 9 9 1 rw0..9 gw0..9 bw0..9 rx0..8 rw10 gx0..8 gw10 bx0..8 bw10
11 12 8 8 8 1 rw0..9 gw0..9 bw0..9 rx0..7 rw11..10 gx0..7 gw11..10 bx0..7 bw11..10
15 16 4 4 4 1 rw0..9 gw0..9 bw0..9 rx0..3 rw15..10 gx0..3 gw15..10 bx0..3 bw15..10
""".strip().split("\n")

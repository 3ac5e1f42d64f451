"""A prefix code over pairs of characters, in which older indexes keep descriptions.

A text of printable ASCII is cut into pairs; a last odd character pairs with the end mark, and a text of even length ends with a pair of end marks.
Bits fill bytes from the lowest; the first is 0.  Any other text is a byte 255 and its UTF-8.  The tree is written in post-order: a
leaf is its two characters, an inner node a byte 255.
"""

from __future__ import annotations

import heapq
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The end mark, and the mark of inner nodes and of other texts.
END, MARK = 127, 255


def pairs_of(text: str) -> list[tuple[int, int]]:
    raw = text.encode()
    raw += bytes([END] * (2 - len(raw) % 2))
    return list(zip(raw[::2], raw[1::2], strict=True))


class Tree:
    """A code: the bits of each pair, and the pairs by their bits."""

    def __init__(self, root: tuple):
        self.root = root
        self.bits: dict[tuple[int, int], str] = {}
        walk = [(root, "")]
        while walk:
            node, bits = walk.pop()
            if isinstance(node[0], int):
                self.bits[node] = bits
            else:
                walk += [(node[0], bits + "0"), (node[1], bits + "1")]

    @staticmethod
    def of(frequencies: dict[tuple[int, int], int]) -> Tree:
        """The two rarest nodes are joined again and again; of equally rare ones the older goes first."""
        number = count()
        queue = [(n, next(number), pair) for pair, n in sorted(frequencies.items())]
        heapq.heapify(queue)
        while len(queue) > 1:
            (a, _, left), (b, _, right) = heapq.heappop(queue), heapq.heappop(queue)
            heapq.heappush(queue, (a + b, next(number), (left, right)))
        return Tree(queue[0][2] if queue else (END, END))

    def to_bytes(self) -> bytes:
        out, walk = [], [self.root]
        while walk:  # from the back: node, right, left
            node = walk.pop()
            if isinstance(node[0], int):
                out.append(bytes(node))
            else:
                out.append(bytes([MARK]))
                walk += [node[0], node[1]]
        return b"".join(reversed(out))

    @staticmethod
    def from_bytes(data: bytes) -> Tree:
        stack: list[tuple] = []
        at = 0
        while at < len(data):
            if data[at] == MARK:
                right, left = stack.pop(), stack.pop()
                stack.append((left, right))
                at += 1
            else:
                stack.append((data[at], data[at + 1]))
                at += 2
        return Tree(stack.pop())

    def compress(self, text: str) -> bytes:
        if not all(" " <= ch <= "~" for ch in text):
            return bytes([MARK]) + text.encode()
        bits = "0" + "".join(map(self.bits.__getitem__, pairs_of(text)))
        return int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")

    def uncompress(self, data: bytes) -> str:
        if data[0] & 1:
            return data[1:].decode()
        if isinstance(self.root[0], int):  # one pair, which holds the end
            return bytes(x for x in self.root if x != END).decode()
        out, node = bytearray(), self.root
        for bit in bin(int.from_bytes(data, "little") | 1 << 8 * len(data))[:2:-1][1:]:
            node = node[bit == "1"]
            if isinstance(node[0], int):
                for x in node:
                    if x == END:
                        return out.decode()
                    out.append(x)
                node = self.root
        return out.decode()


def build(texts: DataFrame, column: str = "value") -> Tree:
    """The code of a column.  Pairs are counted by Spark; the driver gets one row for each pair, 96 * 96 of them at most."""
    v = F.col(column)
    ascii_ = texts.where(v.rlike(r"\A[ -~]*\z")).select(F.rpad(v, (F.length(v) + 2 - F.length(v) % 2).cast("int"), F.lit(chr(END))).alias("v"))
    each = ascii_.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("v"), F.lit(2)), lambda i: F.substring(F.col("v"), i, F.lit(2)))).alias("pair"))
    return Tree.of({(ord(r["pair"][0]), ord(r["pair"][1])): r["n"] for r in each.groupBy("pair").agg(F.count("*").alias("n")).collect()})


def compress(tree: Tree, text: Column) -> Column:
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else tree.compress(t))

    return run(text)


def uncompress(tree: Tree, data: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else tree.uncompress(bytes(b)))

    return run(data)

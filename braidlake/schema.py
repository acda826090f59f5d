"""Options and the handful of shapes that operators exchange.

lines    value STRING, ord
records  rec_type, ord, id, length, sequence, src, dst, orientation_from, orientation_to, overlap, from_start, from_end, to_start, to_end, cigar, name, steps, tags
nodes    node [, sequence, length, tags]
edges    src, dst [, orientation_from, orientation_to], weight [, tags]
matrix   row BIGINT, col BIGINT, value
paths    name, path_rank, pos, node, orient
distance source, node, dist
`ord` is anything that can be ordered and is unique per line: it carries the file order through the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Tag value by kind: integer, float, list of integers, list of strings, or string.
TAG_VALUE = "struct<typ:string,i:bigint,f:double,b:array<bigint>,bs:array<string>,s:string>"
STEPS = "array<struct<seg:string,orient:string>>"

#: Matrix value types by their public names.
DTYPES = {"bool": "boolean", "int8": "tinyint", "int32": "int", "float32": "float", "float64": "double"}
ITEM_BYTES = {"bool": 1, "int8": 1, "int32": 4, "float32": 4, "float64": 8}


@dataclass(frozen=True)
class GraphOptions:
    """How records become a graph.

    bidirected makes two nodes of a segment, `id:+` and `id:-`, and adds to each edge its reverse complement unless
    keep_directed_bidir is set. multigraph keeps parallel edges and the first record's node attributes.
    """

    directed: bool = True
    bidirected: bool = False
    keep_directed_bidir: bool = False
    weight_tag: str | None = None
    store_seq: bool = False
    store_tags: bool = False
    strip_orientation: bool = False
    multigraph: bool = False
    split_on_alignment: bool = False
    raw_bytes_id: bool = False

    @property
    def parallel(self) -> bool:
        """Parallel edges are kept."""
        return self.bidirected or self.multigraph

    @property
    def result_directed(self) -> bool:
        """Whether the graph that comes out has directed edges."""
        if self.bidirected:
            return self.keep_directed_bidir
        return self.directed

    @property
    def matrix_directed(self) -> bool:
        """Whether matrix entries are taken as directed; keep_directed_bidir alone makes them so."""
        return self.keep_directed_bidir or (not self.bidirected and self.directed)

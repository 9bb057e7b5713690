"""Edge lists as text, packed binary and adjacency lists."""

from .edges import (  # noqa: F401
    add_edge_index,
    read_adjacency_text,
    read_binary_edges,
    read_info,
    read_text_edges,
    write_binary_edges,
    write_info,
    write_text_edges,
)

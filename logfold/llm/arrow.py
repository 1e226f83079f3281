"""Arrow batches in pieces of bounded size, for functions that run over text inside tasks."""

import pyarrow as pa

PIECE_BYTES = 2 << 20


def pieces(batches, column: str, limit: int = PIECE_BYTES):
    """Cut batches so that the texts of a piece have at most ``limit`` bytes together, or are one row."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(lengths):
            n = n or 0
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def rows_of(batches):
    """Rows as dicts, one at a time, for rows that are large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]

"""File and vocabulary sources."""

from shelfmark.sources.files import file_stream, list_files, read_by_path, read_files, scan_files
from shelfmark.sources.vocab import parse_vocab, read_vocab

__all__ = [
    "file_stream",
    "list_files",
    "parse_vocab",
    "read_by_path",
    "read_files",
    "read_vocab",
    "scan_files",
]

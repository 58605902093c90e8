"""All query modules of this subpackage, loaded."""

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = (
    "warc_zip",
    "sentencepiece_codec",
    "secret_scan",
    "toxicity",
    "quality_classifier",
    "learned_partitions",
    "html_extraction",
    "decontamination",
    "ngram_join",
    "line_dedup",
    "phrase_mining",
    "prefix_trie",
    "streaming_dedup",
)

for _name in MODULES:
    import_module(f"{__package__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]

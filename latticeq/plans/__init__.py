"""The registered queries of the engine's own operators, one module per family."""

from importlib import import_module

FAMILIES = ("tables", "reports", "alignments", "retrieval", "geometry", "loading", "files", "streams", "models", "noisy", "writes")


def load() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")

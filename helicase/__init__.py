"""Long-amplicon denoising on Spark: template selection (fad) and clustering with consensus (rad) over DataFrames of reads."""

from __future__ import annotations

from importlib import import_module

# Names and the modules that hold them; workers that unpickle one operator don't load the others.
_WHERE = {
    "errors": ["DenoiseError", "EmptyInput", "InvalidBase", "InvalidK", "InvalidParam", "SequenceTooShort"],
    "params": ["AlignParams", "ClusterMode", "ConsensusParams", "DpMeansParams", "FadParams", "RadParams"],
    "plans.fad": ["FadResult", "fad_denoise"],
    "plans.rad": ["RadResult", "rad_denoise"],
}
__all__ = [name for names in _WHERE.values() for name in names]  # noqa: PLE0605


def __getattr__(name: str):
    for module, names in _WHERE.items():
        if name in names:
            return getattr(import_module(f"{__name__}.{module}"), name)
    raise AttributeError(name)

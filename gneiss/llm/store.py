"""The tables that cut lineage, under the name that the operators of this folder use."""

from gneiss.store import cut, free, shared_folder

__all__ = ["cut", "free", "shared_folder"]

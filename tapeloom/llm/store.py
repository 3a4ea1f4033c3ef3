"""The shared tables of the library (tapeloom.shared), under the name that the operators use."""

from __future__ import annotations

from tapeloom.shared import delete, fresh_path, reclaim, shared_folder, written, written_to

__all__ = ["delete", "fresh_path", "reclaim", "shared_folder", "written", "written_to"]

"""Part of the robustness analytics."""

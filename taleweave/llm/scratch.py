"""The shared folder's intermediate tables, under the subpackage's own name."""

from taleweave.scratch import new_folder, shared_folder, stored

__all__ = ["new_folder", "shared_folder", "stored"]

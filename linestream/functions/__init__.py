"""Column expressions: everything here stays inside whole-stage code generation."""

from linestream.functions.languages import display_name, maximal_id, primary_subtag
from linestream.functions.text import slug, trim_script_space, trim_unicode

__all__ = ["display_name", "maximal_id", "primary_subtag", "slug", "trim_script_space", "trim_unicode"]

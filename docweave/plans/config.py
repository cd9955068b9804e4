"""Plans: presets, recipes, configuration files."""

from __future__ import annotations

import json
import tomllib
import warnings
from dataclasses import dataclass, field, fields
from pathlib import Path

# Steps, always run in this order.
STEPS = ("subs_list", "subs_merge", "chunk", "reformat", "bullets", "clean_for_map", "qa", "tree", "cluster", "merge", "refine", "qa_parse", "import_markmap", "map", "enrich_markmap_notes")

# Presets and their steps.
PRESETS: dict[str, tuple[str, ...]] = {
    "reformat": ("chunk", "reformat"),
    "bullets": ("chunk", "bullets"),
    "clean_for_map": ("chunk", "clean_for_map"),
    "qa": ("chunk", "qa"),
    "mindmap": ("chunk", "tree", "cluster", "merge", "refine"),
    "detailed_mindmap": ("chunk", "tree", "cluster", "merge", "refine", "map"),
    "subs_list": ("subs_list",),
    "subs_merge": ("subs_merge",),
    "mindmap_from_qa": ("chunk", "tree", "cluster", "merge", "refine", "qa_parse", "map"),
    "map_qa_onto_markmap": ("qa_parse", "import_markmap", "map"),
    "enrich_markmap_notes": ("import_markmap", "enrich_markmap_notes"),
}
DEFAULT_STEPS = ("chunk", "tree", "cluster", "merge", "refine", "map")

# Recipes as (preset, chunk size).
RECIPES: dict[str, tuple[str, int]] = {
    "mindmap_from_markdown": ("mindmap", 1024),
    "detailed_mindmap_from_markdown": ("detailed_mindmap", 1024),
    "qa_from_markdown": ("qa", 1024),
    "list_notes_in_dir": ("subs_list", 2000),
    "merge_notes_from_manifest": ("subs_merge", 2000),
    "reformat_markdown": ("reformat", 3072),
    "focus_markdown": ("clean_for_map", 2048),
    "outline_markdown": ("bullets", 3072),
    "mindmap_from_qa": ("mindmap_from_qa", 1024),
    "map_qa_onto_markmap": ("map_qa_onto_markmap", 1024),
    "enrich_markmap_notes": ("enrich_markmap_notes", 2000),
}
ALIASES = {
    "list_subtitles_in_dir": "list_notes_in_dir",
    "merge_subtitles_from_manifest": "merge_notes_from_manifest",
    "clarify_markdown": "focus_markdown",
    "bullets_from_markdown": "outline_markdown",
}


@dataclass
class Options:
    """What a plan needs besides its input."""

    input: str | None = None
    markmap_input: str | None = None
    qa_input: str | None = None
    output_dir: str = "output"
    debug_dir: str = "debug"
    run_name: str | None = None
    manifest: str = "file_list.txt"
    include_html: bool = False
    max_tokens: int = 2000
    overlap_tokens: int = 0
    strict_overlap: bool = False
    tokenizer: str = "word_punct"
    steps: tuple[str, ...] | None = None
    preset: str | None = None
    debug: bool = False
    use_debug_io: bool = False
    tracing: bool = False
    min_delay_sec: float = 0.15
    max_retries: int = 4
    map_batch_override: int | None = None
    presets: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(PRESETS))
    prompts: dict[str, str] = field(default_factory=dict)
    folders: bool = False

    def resolved_steps(self) -> tuple[str, ...]:
        """Steps in the order they run: explicit steps, else the preset, else the default; unknown names are errors."""
        if self.steps is not None:
            wanted = self.steps
        elif self.preset is not None:
            if self.preset not in self.presets:
                raise ValueError(f"unknown preset {self.preset!r}; known: {', '.join(sorted(self.presets))}")
            wanted = self.presets[self.preset]
        else:
            wanted = DEFAULT_STEPS
        unknown = set(wanted) - set(STEPS)
        if unknown:
            raise ValueError(f"unknown steps: {', '.join(sorted(unknown))}")
        steps = tuple(s for s in STEPS if s in wanted)
        if "import_markmap" in steps and not self.markmap_input:
            raise ValueError("this plan needs an outline (markmap_input)")
        return steps

    def resolved_name(self) -> str:
        """Run name: given, else the directory's name or the file's stem."""
        if self.run_name:
            return self.run_name
        path = Path(self.input or "run")
        return (path.name if path.is_dir() else path.stem) or "run"


def recipe(name: str) -> Options:
    """Options of a recipe by name, file name or alias."""
    key = name.removesuffix(".toml")
    key = ALIASES.get(key, key)
    if key not in RECIPES:
        raise ValueError(f"unknown recipe {name!r}; known: {', '.join(sorted(RECIPES))}; aliases: {', '.join(sorted(ALIASES))}")
    preset, size = RECIPES[key]
    return Options(preset=preset, max_tokens=size, include_html=preset.startswith("subs_"))


def write_recipes(folder: str) -> list[str]:
    """Write the recipes as editable files; files that exist stay as they are.  Returns what was written."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    made = []
    for name, (preset, size) in RECIPES.items():
        file = target / f"{name}.toml"
        if not file.exists():
            file.write_text(f'[pipeline]\npreset = "{preset}"\n\n[chunk]\nmax_tokens = {size}\noverlap_tokens = 0\n\n[io]\ninclude_html = {str(preset.startswith("subs_")).lower()}\n', encoding="utf-8")
            made.append(file.name)
    return made


# Sections of a configuration file, and the options their entries set.
_SECTIONS = {
    "io": ("input", "markmap_input", "output_dir", "debug_dir", "run_name", "manifest", "include_html"),
    "chunk": ("max_tokens", "overlap_tokens", "strict_overlap", "tokenizer"),
    "runtime": ("debug", "use_debug_io", "min_delay_sec", "max_retries", "map_batch_override"),
    "pipeline": ("steps", "preset"),
}
# Entries of sections that are no longer written.
_LEGACY = {"paths": {"input_file": "input", "output_dir": "output_dir", "debug_dir": "debug_dir", "file_id": "run_name"}, "subtitles": {"file_list": "manifest", "enable_html": "include_html"}}


def parse(text: str, suffix: str) -> dict:
    """Contents of a configuration file; a byte-order mark is ignored."""
    text = text.removeprefix("\ufeff")
    if suffix == ".toml":
        return tomllib.loads(text)
    if suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML files need the yaml package") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def load(path: str | None) -> Options:
    """Options from a file; entries that are not given keep their defaults; older sections are accepted with a warning."""
    if path is None:
        return Options()
    raw = parse(Path(path).read_text(encoding="utf-8"), Path(path).suffix.lower())
    values: dict = {}
    for section, names in _LEGACY.items():
        if section in raw:
            warnings.warn(f"section [{section}] is outdated, use [io]", stacklevel=2)
            values |= {new: raw[section][old] for old, new in names.items() if old in (raw[section] or {})}
    for section, names in _SECTIONS.items():
        values |= {n: (raw.get(section) or {})[n] for n in names if n in (raw.get(section) or {})}
    options = Options(**{k: v for k, v in values.items() if k in {f.name for f in fields(Options)}})
    if options.steps is not None:
        options.steps = tuple(options.steps)
        if options.preset is not None and "steps" in (raw.get("pipeline") or {}):
            options.preset = None  # explicit steps win
    options.tracing = bool((raw.get("tracing") or {}).get("enabled", False))
    options.presets |= {k: tuple(v) for k, v in ((raw.get("presets") or {}).get("named") or {}).items()}
    options.prompts = dict((raw.get("prompts") or {}).get("files") or {})
    return options

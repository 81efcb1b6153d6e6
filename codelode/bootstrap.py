"""Setting a workspace up: configuration files, the session hook and the server's lock."""

from __future__ import annotations

import fcntl
import json
import os
import shutil
from pathlib import Path

from codelode import schema

NAME = "codelode"


#: Agents that need more than the server's entry: what is added to it.
HARNESSES = {"pi": {"directTools": True}}
#: A file that, like an index, opts a workspace in to the session hook.
MARKER = ".codelode.yaml"


def _load(path: Path) -> dict:
    """The object that a file holds; empty if there is none that reads as one."""
    try:
        known = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return known if isinstance(known, dict) else {}


def _member(known: dict, name: str, kind: type):
    """A member of its kind; an empty one in place of anything else."""
    return kind(known[name]) if isinstance(known.get(name), kind) else kind()


def _save(path: Path, value: dict, old: dict) -> bool:
    if value == old and path.exists():
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=2) + "\n", encoding="utf-8")
    return True


def merge_server(root: Path, db: Path, harness: str | None = None) -> bool:
    """Names this server in .mcp.json, leaving all else that reads as it is; whether that changed the file."""
    path = root / ".mcp.json"
    old = _load(path)
    where = db.relative_to(root).as_posix() if db.is_relative_to(root) else str(db)
    servers = _member(old, "mcpServers", dict) | {NAME: {"command": NAME, "args": ["serve", "--db", where], **HARNESSES.get(harness, {})}}
    return _save(path, {**old, "mcpServers": servers}, old)


def _package(root: Path, name: str) -> bool:
    """Whether the agent has a package, its own or the workspace's."""
    home = Path(os.environ.get("PI_CODING_AGENT_DIR") or Path.home() / ".pi" / "agent")
    return any((p / "npm" / "node_modules" / name).exists() for p in (home, root / ".pi"))


# What a harness needs (a program or a package, its name, and how to get it), and what is said of it.
REQUIREMENTS = {"pi": {"pi": ("program", "pi", "npm install -g @earendil-works/pi-coding-agent"), "pi_mcp_adapter": ("package", "pi-mcp-adapter", "pi install npm:pi-mcp-adapter")}}
NOTES = {"pi": "Pi speaks to servers by the package pi-mcp-adapter, which its preset calls for."}


def harness_report(root: Path, harness: str | None) -> dict | None:
    """What a harness needs besides, whether it is there, and how to get what is not."""
    if not harness:
        return None
    needs, guidance = {}, [NOTES[harness]]
    for key, (kind, name, hint) in REQUIREMENTS[harness].items():
        there = shutil.which(name) if kind == "program" else _package(root, name)
        needs[key] = {"installed": bool(there), "install_hint": hint} | ({"executable": there} if kind == "program" else {})
        if not there:
            guidance.append(f"{name} is missing: {hint}")
    return {"name": harness, "config_path": ".mcp.json", "requirements": needs, "guidance": guidance}


def merge_gitignore(root: Path) -> bool:
    path = root / ".gitignore"
    text = path.read_text(encoding="utf-8") if path.exists() else ""
    line = f"{schema.INDEX_DIR}/"
    if line in (x.strip() for x in text.splitlines()):
        return False
    path.write_text(text + ("" if not text or text.endswith("\n") else "\n") + line + "\n", encoding="utf-8")
    return True


def install_hook(folder: Path | None = None) -> dict:
    """Adds the session hook to the user's hooks.json once, in place of an older entry of its own."""
    path = (folder or Path.home() / ".cursor") / "hooks.json"
    created, old = not path.exists(), _load(path)
    hooks, command = _member(old, "hooks", dict), f"{NAME} hook session-start"
    others = [e for e in _member(hooks, "sessionStart", list) if not (isinstance(e, dict) and command in str(e.get("command") or ""))]
    hooks["sessionStart"] = [*others, {"command": command, "type": "command"}]
    changed = _save(path, {"version": 1, **old, "hooks": hooks}, old)
    return {"hooks_path": str(path), "created": created, "changed": changed}


def read_configs(root: Path) -> dict:
    """Whether the editors' files name this server; what is wrong with those that do not read."""
    out = {}
    for name in (".mcp.json", ".cursor/mcp.json"):
        path = root / name
        try:
            known = json.loads(path.read_text(encoding="utf-8"))
            out[name] = {"exists": True, "configured": NAME in _member(known, "mcpServers", dict), "error": None} if isinstance(known, dict) else {"exists": True, "configured": None, "error": "not an object"}
        except FileNotFoundError:
            out[name] = {"exists": False, "configured": False, "error": None}
        except (ValueError, OSError) as e:
            out[name] = {"exists": True, "configured": None, "error": str(e)}
    return out


def init(engine, root: str | Path, db: str | Path | None = None, *, skip_index: bool = False, auto_index: bool = False, force: bool = False, harness: str | None = None, hooks: Path | None = None) -> dict:
    """Merges the configuration and makes the first index; without an index any folder will do, as no tree is walked."""
    from codelode.api import check_root

    if harness is not None and harness not in HARNESSES:
        raise ValueError(f"unsupported harness {harness!r}; one of {', '.join(HARNESSES)}")
    top = check_root(root, force or skip_index)
    where = Path(db).resolve() if db else top / schema.INDEX_DIR
    out = {"status": "ok", "root": str(top), "db": str(where), "mcp_config_changed": merge_server(top, where, harness), "gitignore_changed": merge_gitignore(top), "harness": harness_report(top, harness), "missing_grammars": engine.missing_grammars(top)}
    if not skip_index:
        out["index"] = engine.index(top, where, force=force)
    if auto_index:
        out["hook_changed"] = install_hook(hooks)["changed"]
    return out


def session_start(engine, cwd: str | Path) -> dict:
    """Indexes the workspace around ``cwd`` anew if it is stale; any failure is a payload, not an exception."""
    try:
        from codelode.api import check_root

        here = Path(cwd).resolve()
        root = next((p for p in (here, *here.parents) if (p / schema.INDEX_DIR).is_dir() or (p / MARKER).is_file()), None)
        if root is None:
            return {"status": "skipped", "reason": "no index or marker in this folder or above"}
        check_root(root)
        engine = engine() if callable(engine) else engine
        status = engine.status(root=root)
        if status["exists"] and status["stale"] is False:
            return {"status": "skipped", "reason": "fresh"}
        definitions = bool(_load(root / schema.INDEX_DIR / "metadata.json").get("definitions")) if status["exists"] and not status["error"] else False
        return {"status": "indexed", "index": engine.index(root, definitions=definitions)}
    except Exception as e:  # the hook must not stop a session
        return {"status": "error", "error": str(e)[:200]}


class ServerLock:
    """One server for each index: a locked file beside it that holds the server's process id."""

    def __init__(self, db: str | Path) -> None:
        self.path = Path(f"{Path(db).resolve()}.serve.lock")

    def __enter__(self) -> ServerLock:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.file = open(self.path, "a+")  # noqa: SIM115
        try:
            fcntl.flock(self.file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            self.file.close()
            raise RuntimeError(f"another server holds {self.path}") from None
        self.file.truncate(0)
        self.file.write(str(os.getpid()))
        self.file.flush()
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def probe_server_lock(db: str | Path) -> dict:
    path = Path(f"{Path(db).resolve()}.serve.lock")
    try:
        with open(path) as f:
            try:
                fcntl.flock(f, fcntl.LOCK_SH | fcntl.LOCK_NB)
            except OSError:
                return {"locked": True, "pid": int(f.read() or 0) or None}
    except OSError:
        pass
    return {"locked": False, "pid": None}

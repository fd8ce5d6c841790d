"""Calls resolved through scopes, imports and re-exports."""

from __future__ import annotations

from codeshoal.operators import resolve as RS

FILES = {
    "app/one/util.py": "def load():\n    return helper()\n\ndef helper():\n    pass\n",
    "app/two/util.py": "def load():\n    pass\n",
    "app/one/main.py": "from .util import load\n\ndef run():\n    load()\n",
    "app/two/main.py": "from .util import load as get\n\ndef run():\n    get()\n    load()\n",
    "app/three.py": "import app.two.util as u\nfrom app.one import util\nfrom app import two\n\n"
                    "def go(v):\n    u.load()\n    util.load()\n    v.load()\n    print(1)\n",
    # A re-export through a package, and one more.
    "lib/__init__.py": "from .core import (\n    deep as shallow,\n    other,\n)\n",
    "lib/core.py": "from ._impl import deep, other\n",
    "lib/_impl.py": "def deep():\n    pass\ndef other():\n    pass\n",
    "use.py": "from lib import shallow\nimport lib\nfrom lib.core import *\n\ndef f():\n    shallow()\n"
              "    lib.other()\n    deep()\n    'x'.load()\n",
    # A circle of re-exports leads nowhere.
    "c1.py": "from c2 import ring\ndef a():\n    ring()\n", "c2.py": "from c1 import ring\n",
    "k.py": "class K:\n    def m(self):\n        self.n()\n        self.load()\n    def n(self):\n"
            "        pass\n",
    "js/a.js": "import { pick as p, keep } from './lib/index.js';\nimport * as all from \"./b\";\n"
               "import main from './b';\nfunction go() { p(); keep(); all.bee(); main(); other(); }\n",
    "js/b.js": "export function bee() {}\nfunction main() {}\n",
    "js/lib/index.js": "export { pick } from '../impl';\nexport * from '../impl';\n",
    "js/impl.js": "export function pick() {}\nexport function keep() {}\n",
}


def edges(files):
    return {(r.path, r.name, r.call): (r.target_path, r.target_name, r.how)
            for r in RS.resolved_calls(files).collect()}


def test_calls_follow_scopes_and_imports(make_files):
    got = edges(make_files(FILES))
    assert got[("app/one/util.py", "load", "helper")] == ("app/one/util.py", "helper", "own")
    # Two definitions of a name in two packages get the right caller each.
    assert got[("app/one/main.py", "run", "load")] == ("app/one/util.py", "load", "import")
    assert got[("app/two/main.py", "run", "get")] == ("app/two/util.py", "load", "import")
    assert got[("app/two/main.py", "run", "load")] == ("app/one/util.py", "load", "guess")
    assert got[("app/three.py", "go", "u.load")] == ("app/two/util.py", "load", "import")
    assert got[("app/three.py", "go", "util.load")] == ("app/one/util.py", "load", "import")
    assert got[("app/three.py", "go", "v.load")] == ("app/one/util.py", "load", "guess")
    assert ("app/three.py", "go", "print") not in got


def test_re_exports_are_followed_to_the_definition(make_files):
    got = edges(make_files(FILES))
    assert got[("use.py", "f", "shallow")] == ("lib/_impl.py", "deep", "import")
    assert got[("use.py", "f", "lib.other")] == ("lib/_impl.py", "other", "import")
    assert got[("use.py", "f", "deep")] == ("lib/_impl.py", "deep", "import")
    assert got[("use.py", "f", ".load")] == ("app/one/util.py", "load", "guess")
    assert ("c1.py", "a", "ring") not in got
    assert got[("k.py", "m", "self.n")] == ("k.py", "n", "own")
    assert got[("k.py", "m", "self.load")][2] == "guess"


def test_scripts_import_by_path(make_files):
    got = edges(make_files(FILES))
    assert got[("js/a.js", "go", "p")] == ("js/impl.js", "pick", "import")
    assert got[("js/a.js", "go", "keep")] == ("js/impl.js", "keep", "import")
    assert got[("js/a.js", "go", "all.bee")] == ("js/b.js", "bee", "import")
    assert got[("js/a.js", "go", "main")] == ("js/b.js", "main", "import")
    assert got[("js/a.js", "go", "other")] == ("lib/_impl.py", "other", "guess")


def test_long_chains_and_no_files(make_files):
    chain = {f"m{i}.py": f"from m{i + 1} import end\n" for i in range(40)}
    chain |= {"m40.py": "def end():\n    pass\n", "z.py": "from m0 import end\ndef f():\n    end()\n"}
    assert edges(make_files(chain)) == {("z.py", "f", "end"): ("m40.py", "end", "import")}
    assert edges(make_files({"a.txt": "none"})) == {}

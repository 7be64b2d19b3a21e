"""Functions for Python workers that bring this package's modules along.

A pass's function is sent with the texts of all modules here, and a worker imports them from these: nothing is fetched, unpacked or looked
for on a path, however late an executor comes, and nothing is left in the application that later queries share.
"""

from __future__ import annotations

import functools
import hashlib
import importlib
import pickle
import pkgutil
import zlib
from collections.abc import Callable

from pyspark import cloudpickle

PACKAGE = __name__.partition(".")[0]


@functools.cache
def texts() -> tuple[bytes, str]:
    """Of each module its text and whether it is a package, packed; and what tells these texts from others."""
    top = importlib.import_module(PACKAGE)
    found = {PACKAGE: (top.__spec__.loader.get_source(PACKAGE), True)}
    found |= {m.name: (m.module_finder.find_spec(m.name).loader.get_source(m.name), m.ispkg) for m in pkgutil.walk_packages(top.__path__, f"{PACKAGE}.")}
    packed = zlib.compress(pickle.dumps(sorted(found.items())))
    return packed, hashlib.sha256(packed).hexdigest()


def carried(run: Callable) -> Callable:
    """run with the modules it needs."""
    package, (packed, version), body = PACKAGE, texts(), cloudpickle.dumps(run)

    def bring(*args):  # goes by value, so it names nothing of this module
        import importlib.abc
        import importlib.util
        import sys

        if getattr(sys.modules.get(package), "__carried__", None) != version:
            known = dict(pickle.loads(zlib.decompress(packed)))

            class Carried(importlib.abc.MetaPathFinder, importlib.abc.InspectLoader):
                carries = package

                def find_spec(self, name, path=None, target=None):
                    return importlib.util.spec_from_loader(name, self, origin=f"carried {name}", is_package=known[name][1]) if name in known else None

                def get_source(self, name):
                    return known[name][0]

                def exec_module(self, module):
                    if module.__name__ == package:
                        module.__carried__ = version
                    exec(compile(self.get_source(module.__name__), f"{package}:{module.__name__}", "exec"), module.__dict__)

            for name in [m for m in sys.modules if m.partition(".")[0] == package]:  # a worker used before may have others
                del sys.modules[name]
            sys.meta_path[:] = [Carried(), *(f for f in sys.meta_path if getattr(f, "carries", None) != package)]
        return pickle.loads(body)(*args)

    return bring

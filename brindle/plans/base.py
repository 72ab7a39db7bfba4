from brindle.registry import Registry

registry = Registry()

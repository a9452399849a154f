"""Two small source trees, path to text, whose answers are known: a sample of the language and an application."""

from __future__ import annotations

SAMPLE = {
    "pkg/__init__.py": "",
    "pkg/models.py": "class User:\n    def __init__(self, name):\n        self.name = name\n\n\ndef make_user(name):\n    return User(name)\n",
    "app.py": "from pkg.models import User, make_user\n\n\ndef main():\n    u = make_user('x')\n    return User('y')\n\n\nif __name__ == '__main__':\n    main()\n",
    "config.py": "import os\nfrom pkg import models\nA = os.getenv('A')\n",
    "chain.py": "def a():\n    b()\n\n\ndef b():\n    c()\n\n\ndef c():\n    pass\n\n\ndef recur():\n    recur()\n",
    "alias.py": "from pkg.models import make_user as mw\n\n\ndef twice():\n    mw('a')\n    mw('b')\n",
    "same.py": "class Alpha:\n    def process(self):\n        return helper_prop(self)\n\n\nclass Beta:\n    def process(self):\n        pass\n\n\ndef run(x: Alpha, y: Beta):\n    x.process()\n    y.process()\n\n\ndef helper_prop(o):\n    pass\n",
    "prop.py": "def choices():\n    return []\n\n\nclass Doc:\n    @property\n    def label(self):\n        return choices()\n",
    "views.py": "from prop import Doc\n\n\ndef render(doc: Doc):\n    return doc.label\n",
    "animals.py": "from abc import ABC\n\n\nclass Animal(ABC):\n    def speak(self):\n        pass\n\n\nclass Dog(Animal):\n    def speak(self):\n        pass\n\n\nclass Puppy(Dog):\n    def speak(self):\n        pass\n",
    "cyc/__init__.py": "",
    "cyc/a.py": "import cyc.b\n",
    "cyc/b.py": "from cyc import a\n",
    "cyc/t.py": "from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    import cyc.u\n",
    "cyc/u.py": "import cyc.t\n",
    "io_ops.py": "import os\nimport random\nimport requests\n\n\ndef fetch():\n    return requests.get('http://x')\n\n\ndef jitter():\n    return random.random()\n\n\ndef remember():\n    global STATE\n    STATE = 1\n\n\ndef pure(x):\n    return x\n",
    "pipeline.py": "from io_ops import fetch, jitter\n\n\ndef run_all():\n    fetch()\n    jitter()\n",
    "test_calc.py": "from chain import c\nimport pytest\n\n\n@pytest.mark.slow\ndef test_c():\n    c()\n\n\ndef helper_not_test():\n    c()\n",
}

APP = {
    "app/__init__.py": "",
    "app/core.py": "__all__ = ['exported']\n\n\ndef exported():\n    live_helper()\n\n\ndef live_helper():\n    pass\n\n\ndef truly_dead():\n    orphan_helper()\n\n\ndef orphan_helper():\n    pass\n\n\ndef registered():\n    pass\n\n\nREG = ['app.core:registered']\n",
    "app/shapes.py": "class Shape:\n    def area(self):\n        pass\n\n\nclass Circle(Shape):\n    def area(self):\n        return _pi_helper()\n\n\ndef _pi_helper():\n    return 3\n\n\ndef total(s: Shape):\n    return s.area()\n",
    "app/serial.py": "from rest_framework import serializers\n\n\nclass WidgetSerializer(serializers.Serializer):\n    def get_label(self):\n        pass\n",
    "app/client.py": "import os\nimport time\nimport requests\n\n\nclass Client:\n    def fetch(self):\n        pass\n\n\ndef helper():\n    pass\n\n\nclass Account(requests.Session):\n    pass\n",
    "app/management/commands/backfill.py": "import os\nTOKEN = os.getenv('BACKFILL_TOKEN')\n\n\nclass Command:\n    def add_arguments(self, parser):\n        parser.add_argument('--dry-run')\n",
    "app/settings.py": "import os\nX = os.getenv('X')\nY = os.environ['Y']\n",
    "scripts/use.py": "from app.shapes import total\nfrom app.core import live_helper\ntotal(None)\n",
    "a1.py": "from app.core import live_helper\n\n\ndef one():\n    live_helper()\n",
    "a2.py": "from app.core import live_helper\n\n\ndef two():\n    live_helper()\n",
    "tests/test_app.py": (
        "from unittest.mock import patch\nimport pytest\nfrom a1 import one\n\n\n@pytest.mark.django_db\nclass TestX:\n    @pytest.mark.parametrize('a', [1])\n    def test_one(self):\n        one()\n\n\n"
        "def test_p():\n    patch('app.client.requests')\n    patch('app.client.Client.fetch')\n    patch('app.client.helper')\n    patch('app.client.open')\n    patch('app.client.deleted_fn')\n"
        "    patch('app.client.Client.gone')\n    patch('os.path.exists')\n    patch('app.client.requests.get')\n    patch('app.client.Account.injected')\n    patch(target)\n    patch('app.client.time.sleep')\n    patch('app.client.time.slep')\n"
    ),
}

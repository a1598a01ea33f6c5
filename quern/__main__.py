import sys

from .console import main

sys.exit(main())

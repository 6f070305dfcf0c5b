import sys

from feedlens.cli import main

sys.exit(main())

"""python -m parley"""

from parley.cli import main

main()

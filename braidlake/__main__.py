from braidlake.cli import main

main()

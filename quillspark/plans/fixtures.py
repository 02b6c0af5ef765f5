"""Small texts that reach the rules which the tables do not; they stand beside the documents under negative ids."""

TEXTS = [
    "Harbour logs\n\nThe tide gauge was read twice a day by the\nkeeper of the eastern pier. Its chain was\nreplaced in spring.\n\nEach reading went into a book; see\nFig. 3 for one page of it. Nobody checked the sums, cf. the note by Dr. Hale et\nal. on old tables.",
    "2 She wrote \"the sea is calm today.\"\nThe next line follows the quoted one at once. \n3.1 Rope and tackle\nRopes were bought from one dealer (the cheapest one).] Then they were tarred again.\n4 knots was the mean speed of the boat in\nwinter months.",
    "METHODS:\nWe measured the drift of ten buoys with a plain compass.\n- The first buoy was lost after a storm.\n- The second one\nwas found by a farmer.\n1) A third one came back on its own!\nCONCLUSION\nThe drift shows a clear increase in autumn. However the record remains short and further work is needed.",
    "潮位记录由东码头的看守人每日读取两次。读数写入一本旧账簿！\n他说：“海面今天十分平静安宁。”随后船只离开港口驶向远方。短句。",
    "The appendix and the long table were bound in one volume. One figure was drawn by hand last year. "
    "The figures of the appendix were drawn by hand. Data came from the department of harbours. Write to the keeper at email: pier, or call. "
    "It was printed and published by the town press. Copies are held by the university today.",
    "Readings were 1 and 2 and 3 and 4 and 5 and 6 and 7 and 8 and 9 on that day. A b c d e f words stand here. "
    "The balance = mass + load / span + drag / lift + rest | all \\ none holds. 12345-6789 is the shelf mark of the volume here. "
    "x. Too short. This one has no end mark and goes on for some words",
    "The oxide film was grown by ALD at 200 °C and 5 mTorr under vacuum [1, 2]. X-ray  diffraction and Raman spectroscopy confirm the phase [3-5] , as expected . "
    "A thin film on a silicon wafer shows a clear increase in mobility at 4.2 K and 10 nm [ 6 ]. The so-called finding stays available to all. "
    "Further microscopy is a challenge, however, and requires better samples. We report growth of a heterostructure by sputtering and annealing.",
    "The hyphen-\nated word and a co-\n  operative were found (cid:12) in ■■ old scans ( as usual ) . Spaces before marks , like this ; were kept.\r\nA carriage return parts these lines.\rSo does this one here.",
    "Abstract\nWe study the flow of sand along the pier in this work.\nIntroduction\nSand moves with every tide and the current is strong.\n2. Experimental\nGrains were measured using a sieve and a scale at each station.\nResults and discussion\nThe results demonstrate a decrease of the flow after the repair.\n"
    "Model predictions agree well.\nConclusions\nFuture work requires more stations, and the noise is a limitation.\nReferences\nA list of books follows here and is left out of it.\nSummary\nThe pier holds the sand back, we find, therefore the repair was worth it.",
    "e.g. the keeper wrote i.e. noted the level vs. the mark of Prof. Lund. Refs. 4 and 5 agree with it. The count lasted 10 ms. The next one took longer than that.",
    "",
    None,
]
PAGES = [  # doc_id, page_number, page_text
    (-1, 1, "The keeper reads the gauge at dawn [1,2].  He notes the level in a book."),
    (-1, 2, ""),
    (-1, 3, "Raw levels go to the town hall every week. He notes the level in a book."),
    (-2, 1, "The film[1]grown by ALD covers the whole wafer. Annealing was done at night in air."),
    (-2, 2, "Its mobility shows an increase [2 , 3] after annealing. The sample was prepared by sputtering in vacuum. However, the yield remains low."),
]
LINES = [
    "2.1 Methods", "Model predictions agree well.", "Mild results were seen.", "The references say so", "IV. Discussion", "A line of prose", "Background of it all", "7 Summary and outlook",
    "Experimental details of the seven long winter voyages", "experimental  setup", "Resultsof it", "Findings: none", "", "Materials and methods", "CONCLUSIONS", "Future work is needed",
]
CITED = [
    "Grown [1] by ALD [2,3] in air .", "No marks here.", "Seen before [4-6], and again [7].", "Kept [ 1 ] apart and [1,2,] listed.", "A range [1–3] with a long dash stays.", "Letters [a1] stay , too !",
]
NAMES = ["a.txt", "a (2).txt", "a.txt", "a.txt", "b.md", "b.md", "a (2).txt", "c", "c", "c (2)", "c (4)", "c", "c", "x.tar.gz", "x.tar.gz", ".rc", ".rc", "a (2) (2).txt"]

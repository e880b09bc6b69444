import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from locusgrid.session import local_session  # noqa: E402

FILES = {
    "me.txt": """# Array calls in the layout of 23andMe, made up for these tests
# Positions on build 37
# rsid\tchromosome\tposition\tgenotype
rs5012\t3\t41000\tCT
rs5020\t3\t52500\tTT
rs5033\t9\t7100\tAC
rs5034\t9\t7200\t--
rs5050\t14\t88000\tGG
rs5061\t14\t90100\tDD
""",
    "regions.txt": """# More made-up calls, 23andMe layout
# rsid\tchromosome\tposition\tgenotype
rs700\t5\t1000\tAA
rs710\t5\t2500\tAG
rs720\t5\t4000\tTT
rs730\t5\t9000\t--
rsY1\tY\t300\tC
rsY2\tY\t8000\tG
rsM1\tMT\t20\tA
rsM2\tMT\t140\tT
""",
    "ancestry.txt": "#Made up, as AncestryDNA writes it\n#Build 37\nrsid\tchromosome\tposition\tallele1\tallele2\n"
                    "rs5012\t3\t41000\tC\tT\nrs5020\t3\t52500\tT\tT\nrs5033\t9\t7100\tA\tC\nrs5090\t20\t15\tG\tA\n",
    "heritage.csv": '# Made up, as MyHeritage writes it\nRSID,CHROMOSOME,POSITION,RESULT\n'
                    '"rs5012","3","41000","CT"\n"rs5033","9","7100","AC"\n',
    "map.tsv": "# id, place and alleles\nrs5012\tchr3\t41000\tC\tT\nrs5020\tchr3\t52500\tT\tG\n"
               "rs5033\tchr9\t7100\tA\tC\nrs5034\tchr9\t7200\tA\tG\n",
    "s.fasta": ">ctgA first contig\nACGTTGCAAC\nGGATC\n>ctgB\nTTTTTTTT\nNNRYA\n>ctgC note here\nGCGCGGCC\n>ctgD\nAT\n",
    "s.fastq": "@m1 long\nACGTA\n+\nIIIII\n@m2\nGGC\n+\n5?I\n@m3\nNNNNN\n+\n&&&&&\n",
    "s.vcf": "\n".join([
        "##fileformat=VCFv4.2", "##contig=<ID=7,length=5000>", '##INFO=<ID=DB,Number=0,Type=Flag,Description="known">',
        '##INFO=<ID=AF,Number=A,Type=Float,Description="share">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="call">',
        '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="depths">',
        *("\t".join(r.split()) for r in (
            "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT subjA subjB",
            "7 1200 rs61 A C 12.5 PASS AF=0.5 GT:AD 0/1:4,. 0/0:9,0",
            "7 1300 rs62 G A 99 PASS DB;AF=0.1 GT 1/1 .",
            "7 1450 . TTC T 20 lowq . GT 0/1 0/1",
            "8 300 . C CAGT 71 PASS AF=0.2;AF=0.3 GT 0/1 ./.",
            "8 410 rs70 AT GC 5 PASS AF=.,0.4 GT 0/0 0/1",
            "8 500 rs71 T C . PASS AF=1 GT 1/1 1/1"))]) + "\n",
    "s.sam": "\n".join("\t".join(r.split()) for r in (
        "@HD VN:1.6", "@SQ SN:chr5 LN:2000", "@SQ SN:chr6 LN:1000",
        "q1 0 chr5 50 60 6M * 0 0 ACGTAC IIIIII", "q2 16 chr5 55 60 4M * 0 0 GGTT IIII",
        "q3 1040 chr6 10 30 5M * 0 0 CCCCC IIIII", "q4 4 * 0 0 * * 0 0 NNN ###",
        "q5 0 chr6 900 60 8M * 0 0 ACACACAC IIIIIIII")) + "\n",
    "s.bed": "chr4\t10\t60\tpeak1\t7\t-\nchr4\t500\t1700\tpeak2\t9\t+\nchr4\t1650\t1660\tpeak3\t1\t+\nchrX\t5\t6\tpeak4\t0\t-\n",
    "s.gff": "##gff-version 3\n5\town\tmRNA\t11\t90\t.\t-\t.\tID=tx9;Note=a\n5\town\tCDS\t11\t40\t.\t-\t0\tID=cds9;Parent=tx9\n"
             "5\town\tCDS\t70\t90\t.\t-\t0\tID=cds10;Parent=tx9\n6\town\tmRNA\t5\t8\t.\t+\t.\tID=tx8\n",
    "s.gtf": '5\town\tCDS\t11\t40\t.\t-\t.\tgene_id "gA"; transcript_id "tA1"\n'
             '6\town\tCDS\t5\t8\t.\t+\t.\tgene_id "gB"; transcript_id "tB1"\n',
    "chip.csv": "Illumina\n[Header]\nA,B\n[Assay]\nIlmnID,Name,Chr\nx,rs1,1\ny,rs2,1\nz,cnv3,1\nw,rs4,2\nw,rs4,2\n[Controls]\nq,rs9,1\n",
    "dbsnp.vcf": "##fileformat=VCFv4.0\n1\t10\trs1\tA\tG\t.\t.\tX=1\n1\t20\trs2\tC\tT,G\t.\t.\tX\n1\t30\trs4\tAT\tA\t.\t.\tX\n"
                 "2\t40\trs77\tG\tA\t.\t.\tX\n2\t50\trs4\tG\tC\t.\t.\tX\n",
}


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4)


@pytest.fixture(scope="session")
def data(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    for name, text in FILES.items():
        (root / name).write_text(text)
    return str(root)
